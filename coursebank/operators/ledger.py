"""Orders, payments and credits as batch jobs.

Per-order and per-user histories are never collected: each outcome is an aggregate that combines
before the shuffle, a running sum over blocks of time, or a fold over sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank.functions import replies as rp
from coursebank.functions import text as tx

c = F.col
TOLERANCE = 1000


def _orders(txn: DataFrame) -> DataFrame:
    return txn.select(c("order_code").alias("code"), "user_id", c("amount_vnd").alias("expected"), "credits_added",
                      c("status").alias("old_status"))


def _join_known(rows: DataFrame, other: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join on ``key``. Rows without one match nothing; they are dealt out by ``row_id`` instead of sharing a task."""
    at = F.coalesce(c(key), F.concat(F.lit("\x00"), c(row_id).cast("string")))
    return rows.withColumn("join_key", at).join(other.withColumnRenamed(key, "join_key"), "join_key", "left").drop("join_key")


def match_transfers(notes: DataFrame, txn: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Notes (note_id, ts, content, amount) with their order and whether the amount fits.

    The amount is tested only when one is given.
    """
    read = notes.withColumn("code", rp.order_code(c("content")))
    rows = _join_known(read, _orders(txn), "code", "note_id")
    fits = (c("amount") <= 0) | (F.abs(c("amount") - c("expected")) <= tolerance)
    return rows.withColumn("amount_fits", F.coalesce(fits, F.lit(False)))


def settle_transfers(notes: DataFrame, txn: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Outcome of each transfer note; the first fitting one of an unpaid order settles it.

    The winner of an order is a minimum, so many notes for one order combine before the shuffle.
    """
    rows = match_transfers(notes, txn, tolerance)
    open_order = c("old_status") != "paid"
    winners = rows.where(c("amount_fits") & open_order).groupBy("code").agg(
        F.min(F.struct("ts", "note_id")).alias("winner"))
    rows = _join_known(rows, winners, "code", "note_id").withColumn("me", F.struct("ts", "note_id"))
    blank = c("content").isNull() | (c("content") == "")
    outcome = (
        F.when(blank, "missing_content").when(c("code").isNull(), "no_code")
        .when(c("old_status").isNull(), "order_not_found")
        .when(~open_order | (c("winner") < c("me")), "already_paid")
        .when(~c("amount_fits"), "amount_mismatch").otherwise("settled")
    )
    settled = outcome == "settled"
    return rows.select(
        "note_id", "ts", "code", "user_id", "amount", "expected", outcome.alias("outcome"),
        F.when(settled, c("credits_added")).otherwise(F.lit(0)).cast("bigint").alias("credits"))


def apply_settlements(txn: DataFrame, settled: DataFrame) -> DataFrame:
    """Orders after settlement: paid at the time of the settling note."""
    paid = settled.where(c("outcome") == "settled").select(c("code").alias("order_code"), c("ts").alias("new_paid_at"))
    rows = txn.join(paid, "order_code", "left")
    hit = c("new_paid_at").isNotNull()
    return rows.withColumns({
        "status": F.when(hit, "paid").otherwise(c("status")), "paid_at": F.coalesce("new_paid_at", "paid_at"),
        "payment_method": F.when(hit, "bank_transfer").otherwise(c("payment_method"))}).drop("new_paid_at")


def gateway_notices(notices: DataFrame, txn: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Answer code of each gateway notice (notice_id, ts, code, amount, response, signed).

    97 bad signature, 01 unknown order, 02 already paid, 04 wrong amount, else 00; of the 00 ones a
    response other than 00 marks the order failed.
    """
    rows = _join_known(notices, _orders(txn), "code", "notice_id")
    fits = F.abs(c("amount") - c("expected")) <= tolerance
    open_order = c("old_status") != "paid"
    pays = c("signed") & F.coalesce(fits & open_order, F.lit(False)) & (c("response") == "00")
    winners = rows.where(pays).groupBy("code").agg(F.min(F.struct("ts", "notice_id")).alias("winner"))
    rows = _join_known(rows, winners, "code", "notice_id").withColumn("me", F.struct("ts", "notice_id"))
    answer = (
        F.when(~c("signed"), "97").when(c("old_status").isNull(), "01")
        .when(~open_order | (c("winner") < c("me")), "02").when(~fits, "04").otherwise("00")
    )
    rows = rows.withColumn("answer", answer)
    effect = F.when(c("answer") != "00", "none").when(c("response") == "00", "paid").otherwise("failed")
    return rows.select("notice_id", "ts", "code", "answer", effect.alias("effect"))


def gateway_returns(returns: DataFrame, txn: DataFrame) -> DataFrame:
    """Effect of each return page (notice_id, ts, code, response, signed): it settles without an amount test."""
    rows = _join_known(returns, _orders(txn), "code", "notice_id")
    open_order = c("old_status") != "paid"
    pays = c("signed") & F.coalesce(open_order, F.lit(False)) & (c("response") == "00")
    winners = rows.where(pays).groupBy("code").agg(F.min(F.struct("ts", "notice_id")).alias("winner"))
    first_fail = rows.where(c("signed") & (c("old_status") == "pending") & (c("response") != "00")).groupBy("code").agg(
        F.min(F.struct("ts", "notice_id")).alias("failer"))
    rows = _join_known(_join_known(rows, winners, "code", "notice_id"), first_fail, "code", "notice_id")
    rows = rows.withColumn("me", F.struct("ts", "notice_id"))
    paid_before = ~open_order | F.coalesce(c("winner") < c("me"), F.lit(False))
    effect = (
        F.when(~c("signed"), "bad_signature").when(c("old_status").isNull(), "not_found")
        .when(c("response") == "00", F.when(paid_before, "already_paid").otherwise("paid"))
        .when((c("old_status") == "pending") & ~paid_before & (c("failer") == c("me")), "failed").otherwise("none")
    )
    return rows.select("notice_id", "ts", "code", effect.alias("effect"))


def expire_pending(txn: DataFrame, as_of: str, minutes: int = 30) -> DataFrame:
    """Orders with pending ones of at least ``minutes`` cancelled."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTE")
    late = (c("status") == "pending") & (c("created_at") <= cutoff)
    return txn.withColumn("status", F.when(late, "cancelled").otherwise(c("status")))


PAYING = ("transfer", "approve", "gateway_ok", "return_ok")
PENDING_ONLY = {"reject": "failed", "cancel": "cancelled", "expire": "cancelled", "return_fail": "failed"}


def replay_orders(events: DataFrame) -> DataFrame:
    """Final state of each order from its events (order_code, ts, seq, kind), starting pending.

    Paid is final and can be reached from every state. Without a payment a failed gateway notice
    decides, else the first event that acts on pending orders. So a state is three aggregates.
    """
    kind = c("kind")
    acts = F.create_map(*[F.lit(x) for pair in PENDING_ONLY.items() for x in pair])
    rows = events.groupBy("order_code").agg(
        F.min(F.when(kind.isin(*PAYING), F.struct("ts", "seq", "kind"))).alias("pay"),
        F.max(kind == "gateway_fail").alias("gateway_failed"),
        F.min_by(F.try_element_at(acts, kind), F.when(kind.isin(*PENDING_ONLY), F.struct("ts", "seq"))).alias("first_act"))
    status = (F.when(c("pay").isNotNull(), "paid").when(c("gateway_failed"), "failed")
              .otherwise(F.coalesce("first_act", F.lit("pending"))))
    return rows.select("order_code", status.alias("status"), c("pay.ts").alias("paid_at"), c("pay.kind").alias("paid_by"))


def running_balance(start: DataFrame, changes: list[DataFrame], adjustments: DataFrame, block: str = "DAY") -> DataFrame:
    """Balance of each user after plain changes and clamped adjustments, in the order of their times.

    ``start`` has user_id and credits, ``changes`` user_id, ts and delta (added as they are), ``adjustments`` user_id, ts,
    seq and delta (``max(0, balance + delta)``). A change is the map ``x -> max(x + sum, floor)`` with no floor where it
    isn't clamped, and such maps compose: after all of them the balance is ``S + max(start, -min S_i)``, S the sum of all
    and S_i the running sum up to each clamped one. So most rows only need sums: changes and adjustments are summed per
    user and block of time, with map-side combination, and only blocks that hold an adjustment are put in order. Changes
    of the same time come before adjustments. Rows without a user are left out, those without a time come first, in a
    block of their own; a user without a start has 0.
    """
    plain = [x.select("user_id", c("ts").cast("timestamp_ntz").alias("ts"), c("delta").cast("long").alias("delta")) for x in changes]
    clamped = adjustments.where("user_id IS NOT NULL").select(
        "user_id", c("ts").cast("timestamp_ntz").alias("ts"), c("seq").cast("long").alias("seq"), c("delta").cast("long").alias("delta"))
    both = clamped.withColumn("floor", F.lit(True))
    for x in plain:
        both = both.unionByName(x.where("user_id IS NOT NULL").withColumns({"seq": F.lit(None).cast("long"), "floor": F.lit(False)}))
    both = both.where("delta IS NOT NULL").withColumn("block", F.date_trunc(block, "ts"))
    sums = both.groupBy("user_id", "block").agg(F.sum("delta").alias("total"))
    marked = clamped.where("delta IS NOT NULL").select(
        c("user_id").alias("u"), F.date_trunc(block, "ts").alias("b")).distinct()
    held = both.join(marked, (c("user_id") == c("u")) & c("block").eqNullSafe(c("b")), "left_semi")
    inner = W.partitionBy("user_id", "block").orderBy("ts", "floor", "seq").rowsBetween(W.unboundedPreceding, 0)
    lows = held.withColumn("run", F.sum("delta").over(inner)).where("floor").groupBy("user_id", "block").agg(F.min("run").alias("low"))
    lows = lows.select(c("user_id").alias("u"), c("block").alias("b"), "low")
    blocks = sums.join(lows, (c("user_id") == c("u")) & c("block").eqNullSafe(c("b")), "left").drop("u", "b")
    outer = W.partitionBy("user_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    based = blocks.withColumn("base", F.coalesce(F.sum("total").over(outer), F.lit(0)))
    per_user = based.groupBy("user_id").agg(F.sum("total").alias("total"), F.min(c("base") + c("low")).alias("low"))
    out = start.select("user_id", c("credits").cast("long").alias("credits")).join(per_user, "user_id", "full")
    credits, total = F.coalesce("credits", F.lit(0)), F.coalesce("total", F.lit(0))
    return out.select("user_id", credits.alias("credits"), (total + F.greatest(credits, -c("low"))).alias("balance"))


def adjust_credits(users: DataFrame, deltas: DataFrame, block: str = "DAY") -> DataFrame:
    """Credits after ordered changes ``max(0, credits + delta)``, for deltas (user_id, ts, seq, delta)."""
    start = users.select(c("id").alias("user_id"), "credits")
    known = running_balance(start, [], deltas, block)
    return known.join(start.select("user_id"), "user_id", "left_semi")


ADMITTED = "job_id long, user_id long, requested long, charge long, balance_before long, admitted boolean"


def _admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold over rows sorted by user and time; the state is the last user and that user's balance."""
    last, balance = None, 0
    for batch in batches:
        charges, before, admitted = [], [], []
        for user, start, requested, produced in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            if user != last:
                last, balance = user, start
            ok = requested is not None and balance >= requested
            before.append(balance)
            admitted.append(ok)
            charges.append(produced if ok else 0)
            balance -= charges[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(3), pa.array(charges, pa.int64()), pa.array(before, pa.int64()),
             pa.array(admitted, pa.bool_())], names=["job_id", "user_id", "requested", "charge", "balance_before", "admitted"])


def admit_jobs(requests: DataFrame, balances: DataFrame) -> DataFrame:
    """Admission of jobs (job_id, user_id, ts, requested, produced) against the balance at their time.

    An admitted job costs what it produced; a refused one is not run and costs nothing, as does a failed one
    (NULL). Whether a job is admitted depends on all admissions before it, so the jobs of a user are folded in
    order; the sort spills, and the fold holds one number, so a busy user needs time but no memory. A job without
    a time comes first, one without a requested amount is refused, and one without a user meets a balance of 0
    that nothing is charged to.
    """
    rows = requests.select(
        c("job_id").cast("long"), c("user_id").cast("long"), "ts", c("requested").cast("long"),
        F.coalesce(c("produced").cast("long"), F.lit(0).cast("long")).alias("produced"))
    known = rows.where("user_id IS NOT NULL").join(
        balances.select(c("user_id").cast("long"), c("balance").cast("long").alias("start")), "user_id", "left")
    ordered = known.repartition("user_id").sortWithinPartitions("user_id", "ts", "job_id")
    folded = ordered.select(
        "job_id", "user_id", F.coalesce("start", F.lit(0).cast("long")).alias("start"), "requested", "produced").mapInArrow(_admit, ADMITTED)
    free = F.coalesce(c("requested") <= 0, F.lit(False))
    nobody = rows.where("user_id IS NULL").select(
        "job_id", "user_id", "requested", F.when(free, c("produced")).otherwise(0).alias("charge"),
        F.lit(0).cast("long").alias("balance_before"), free.alias("admitted"))
    return folded.unionByName(nobody)


def paid_within(orders: DataFrame, payments: DataFrame, minutes: int = 30, step: str = "HOUR") -> DataFrame:
    """Payments that follow an order of the same user within ``minutes``, with the latest such order.

    An interval join on (user, time bucket): an order is put into every bucket of its span, so each
    payment meets only orders near it, whatever a user's whole history.
    """
    span = F.expr(f"INTERVAL {minutes} MINUTE")
    bucket = lambda x: F.date_trunc(step, x)
    left = orders.select("user_id", "order_id", c("ts").alias("ordered_at")).withColumn(
        "bucket", F.explode(F.sequence(bucket(c("ordered_at")), bucket(c("ordered_at") + span), F.expr(f"INTERVAL 1 {step}"))))
    right = payments.select("user_id", "payment_id", c("ts").alias("paid_at")).withColumn("bucket", bucket(c("paid_at")))
    hits = right.join(left, ["user_id", "bucket"]).where(
        (c("paid_at") >= c("ordered_at")) & (c("paid_at") <= c("ordered_at") + span))
    best = hits.groupBy("payment_id").agg(F.max(F.struct("ordered_at", "order_id")).alias("o"), F.count("*").alias("n_orders"))
    return best.select("payment_id", c("o.order_id").alias("order_id"), "n_orders")


def audit_signatures(notices: DataFrame, secret: str, params: str = "params", given: str = "signature") -> DataFrame:
    """Compare the given signature with HMAC-SHA512 over the key-sorted parameters."""
    signed = F.map_filter(params, lambda k, v: ~k.isin("vnp_SecureHash", "vnp_SecureHashType"))
    expected = rp.hmac_sha512(rp.signed_text(signed), secret)
    return notices.withColumn("signature_ok", F.lower(F.coalesce(given, F.lit(""))) == F.lower(expected))


def _decide(cooldown: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fold over requests sorted by address and time; the state is the last accepted request of the last address."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mail, at, confirmed = None, None, None
        for batch in batches:
            accepted = []
            for email, ts, seen in zip(batch.column("email").to_pylist(), *(
                    batch.column(x).cast(pa.int64()).to_pylist() for x in ("ts", "confirmed_at"))):
                if email != mail:
                    mail, at, confirmed = email, None, None
                open_still = at is not None and ts is not None and at >= ts - cooldown and (confirmed is None or confirmed > ts)
                accepted.append(not open_still)
                if not open_still:
                    at, confirmed = ts, seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted, pa.bool_())], names=[*batch.schema.names, "accepted"])

    return fold


def deletion_requests(events: DataFrame, cooldown: int = 15, ttl_hours: int = 48) -> DataFrame:
    """Outcome of deletion requests and confirmations (event_id, ts, email, kind, request_id).

    A request is refused while an unconfirmed one of the same address is younger than the cooldown, so whether one is
    accepted depends on those before it, and the requests of an address are folded in order; the sort spills, and the
    fold holds one request, so a busy address needs time but no memory.
    """
    email = F.lower(tx.strip(c("email")))
    rows = events.withColumn("email", email)
    asks = rows.where((c("kind") == "request") & c("email").contains("@"))
    limit = F.expr(f"INTERVAL {ttl_hours} HOUR")
    # The first confirmation within the life of its request; one before the request finds nothing.
    confirms = rows.where(c("kind") == "confirm").select(c("request_id").alias("event_id"), c("ts").alias("confirm_ts"))
    in_time = confirms.join(asks.select("event_id", "ts"), "event_id").where(
        (c("confirm_ts") >= c("ts")) & (c("confirm_ts") <= c("ts") + limit))
    first = in_time.groupBy("event_id").agg(F.min("confirm_ts").alias("confirmed_at"))
    asks = asks.drop("request_id").join(first, "event_id", "left").select(
        "email", c("event_id").cast("long").alias("event_id"), c("ts").cast("timestamp_ntz").alias("ts"),
        c("confirmed_at").cast("timestamp_ntz").alias("confirmed_at"))
    ordered = asks.repartition("email").sortWithinPartitions("email", "ts", "event_id", "confirmed_at")
    out = ordered.mapInArrow(_decide(cooldown * 60_000_000), "email string, event_id long, ts timestamp_ntz, confirmed_at timestamp_ntz, accepted boolean")
    return out.select(
        "event_id", "email", c("ts").alias("created_at"), "accepted", F.when(c("accepted"), c("ts") + limit).alias("expires_at"),
        F.when(c("accepted"), c("confirmed_at")).alias("confirmed_at"))


def job_status(events: DataFrame, as_of: str, keep: int = 10) -> DataFrame:
    """Latest progress of each job (job_id, ts, seq, percent, phase, done); finished ones older than ``keep`` minutes drop out."""
    latest = events.groupBy("job_id").agg(F.max_by(F.struct("ts", "percent", "phase", "done"), F.struct("ts", "seq")).alias("s"))
    rows = latest.select("job_id", "s.*")
    return rows.where(~F.coalesce("done", F.lit(False)) | (c("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {keep} MINUTE")))


def windowed_revenue(payments: DataFrame, width: str, ts: str = "ts", amount: str = "amount") -> DataFrame:
    """Payments and revenue per tumbling window; the same plan serves batch and stream."""
    win = F.window(ts, width)
    return payments.groupBy(win.alias("w")).agg(
        F.count("*").alias("n"), F.sum(amount).alias("revenue")).select(
        c("w.start").alias("window_start"), "n", "revenue")
