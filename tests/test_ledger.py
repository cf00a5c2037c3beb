import random
from datetime import datetime, timedelta

import pytest

from coursebank.operators import ledger as lg

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_settlement(spark):
    txn = spark.createDataFrame(
        [("1", 7, 10000, 10, "pending"), ("2", 7, 10000, 10, "paid"), ("3", 8, 10000, 10, "cancelled")],
        "order_code string, user_id bigint, amount_vnd bigint, credits_added bigint, status string")
    notes = [(1, at(0), "dh 1", 11001.0), (2, at(1), "DH1 x", 11000.0), (3, at(2), "DH1", 10000.0), (4, at(3), "DH 2", 10000.0),
             (5, at(4), "dh3", 0.0), (6, at(5), "DH9", 1.0), (7, at(6), "none", 1.0), (8, at(7), "", 1.0), (9, at(8), "DH1", 1.0)]
    df = spark.createDataFrame(notes, "note_id bigint, ts timestamp_ntz, content string, amount double")
    got = {r.note_id: r.outcome for r in lg.settle_transfers(df, txn).collect()}
    assert got == {1: "amount_mismatch", 2: "settled", 3: "already_paid", 4: "already_paid", 5: "settled", 6: "order_not_found",
                   7: "no_code", 8: "missing_content", 9: "already_paid"}


def replay(kinds):
    state, paid_by = "pending", None
    for k in kinds:
        if state == "paid":
            break
        if k in lg.PAYING:
            state, paid_by = "paid", k
        elif k == "gateway_fail":
            state = "failed"
        elif k in lg.PENDING_ONLY and state == "pending":
            state = lg.PENDING_ONLY[k]
    return state, paid_by


def test_replay_equals_sequential(spark):
    rng, rows, want = random.Random(5), [], {}
    kinds = [*lg.PAYING, *lg.PENDING_ONLY, "gateway_fail", "noise"]
    for code in range(200):
        seq = [rng.choice(kinds[4:] if code % 2 else kinds) for _ in range(rng.randint(1, 6))]
        want[str(code)] = replay(seq)
        rows += [(str(code), at(i), i, k) for i, k in enumerate(seq)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "order_code string, ts timestamp_ntz, seq bigint, kind string")
    assert {r.order_code: (r.status, r.paid_by) for r in lg.replay_orders(df).collect()} == want


@pytest.mark.parametrize("block", ["HOUR", "DAY"])
def test_clamped_credits_equal_sequential(spark, block):
    rng, rows, want = random.Random(7), [], {}
    start = {u: rng.randint(0, 30) for u in range(30)}
    for u in range(29):
        balance, t = start[u], 0
        for seq in range(rng.randint(1, 120 if u == 0 else 25)):
            t += rng.choice([0, 5, 50, 700])
            delta = rng.randint(-30, 25)
            balance = max(0, balance + delta)
            rows.append((u, at(t), seq, delta))
        want[u] = balance
    want[29] = start[29]
    users = spark.createDataFrame(list(start.items()), "id bigint, credits bigint")
    deltas = spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz, seq bigint, delta bigint")
    assert {r.user_id: r.balance for r in lg.adjust_credits(users, deltas, block).collect()} == want


def test_admission(spark):
    jobs = [(1, 1, at(0), 5, 4), (2, 1, at(2000), 5, None), (3, 1, at(4000), 7, 0), (4, 1, at(4001), 6, 6), (5, 1, at(9000), 1, 0)]
    df = spark.createDataFrame(jobs, "job_id bigint, user_id bigint, ts timestamp_ntz, requested bigint, produced bigint")
    balances = spark.createDataFrame([(1, 10)], "user_id bigint, balance bigint")
    got = {r.job_id: (r.balance_before, r.admitted) for r in lg.admit_jobs(df, balances).collect()}
    assert got == {1: (10, True), 2: (6, True), 3: (6, False), 4: (6, True), 5: (0, False)}


def test_refused_jobs_cost_nothing(spark):
    jobs = [(1, 1, at(0), 60, 9), (2, 1, at(1), 8, 9), (3, 1, None, 2, 1), (4, 1, at(2), None, 5), (5, None, at(0), 0, 3),
            (6, None, at(1), 1, 3), (7, 2, at(0), 0, 0)]
    df = spark.createDataFrame(jobs, "job_id bigint, user_id bigint, ts timestamp_ntz, requested bigint, produced bigint")
    balances = spark.createDataFrame([(1, 10)], "user_id bigint, balance bigint")
    got = {r.job_id: (r.balance_before, r.admitted, r.charge) for r in lg.admit_jobs(df, balances).collect()}
    assert got == {3: (10, True, 1), 1: (9, False, 0), 2: (9, True, 9), 4: (0, False, 0), 5: (0, True, 3), 6: (0, False, 0),
                   7: (0, True, 0)}


def test_paid_within_bounds(spark):
    orders = spark.createDataFrame([(1, 10, at(50)), (1, 11, at(59)), (2, 12, at(0))], "user_id bigint, order_id bigint, ts timestamp_ntz")
    pays = spark.createDataFrame([(1, 1, at(80)), (1, 2, at(81)), (1, 3, at(89)), (1, 4, at(90)), (2, 5, at(10))],
                                 "user_id bigint, payment_id bigint, ts timestamp_ntz")
    got = {r.payment_id: (r.order_id, r.n_orders) for r in lg.paid_within(orders, pays).collect()}
    assert got == {1: (11, 2), 2: (11, 1), 3: (11, 1), 5: (12, 1)}


def test_deletion_cooldown(spark):
    rows = [(1, at(0), " A@x ", "request", None), (2, at(10), "a@x", "request", None), (3, at(15), "a@x", "request", None),
            (4, at(16), "a@x", "request", None), (5, at(30), "b@x", "request", None), (6, at(31), "b@x", "confirm", 5),
            (7, at(32), "b@x", "request", None), (8, at(5000), "b@x", "confirm", 7), (9, at(33), "none", "request", None)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, email string, kind string, request_id bigint")
    got = {r.event_id: (r.accepted, r.confirmed_at) for r in lg.deletion_requests(df).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (False, None), 4: (True, None), 5: (True, at(31)), 7: (True, None)}


def test_running_balance_equals_a_fold(spark):
    rng, start, plain, clamped, want = random.Random(8), [], [], [], {}
    for user in range(40):
        credits, ops = rng.randint(0, 20), []
        for i in range(rng.randint(0, 30)):
            when = at(rng.choice([0, 5, 600, 1500, 1500, 3000, 9000]))
            ops.append((when, rng.random() < 0.4, i, rng.randint(-15, 12)))
        balance = credits
        for when, floor, i, delta in sorted(ops):
            balance = max(0, balance + delta) if floor else balance + delta
            (clamped if floor else plain).append((user, when, i, delta))
        want[user] = balance
        start.append((user, credits))
    plain += [(None, at(1), 0, 99), (99, at(0), 0, 7)]
    want[99] = 7
    schema = "user_id bigint, ts timestamp_ntz, seq bigint, delta bigint"
    plain, clamped = (spark.createDataFrame(x, schema) for x in (plain, clamped))
    parts = [plain.where("seq % 2 = 0"), plain.where("seq % 2 = 1").withColumn("extra", plain.seq)]
    got = lg.running_balance(spark.createDataFrame(start, "user_id bigint, credits bigint"), parts, clamped).collect()
    assert {r.user_id: r.balance for r in got} == want
    none = lg.running_balance(spark.createDataFrame(start, "user_id bigint, credits bigint"), [], clamped.where("false")).collect()
    assert {r.user_id: r.balance for r in none} == dict(start)


def test_adjustments_without_a_time_come_first(spark):
    schema = "user_id bigint, ts timestamp_ntz, seq bigint, delta bigint"
    changes = spark.createDataFrame([(1, None, 1, -50), (1, at(0), 2, 4), (1, at(0), 3, None)], schema)
    got = lg.running_balance(spark.createDataFrame([(1, 10)], "user_id bigint, credits bigint"), [], changes).first()
    assert got.balance == 4
