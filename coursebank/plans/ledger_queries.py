"""Queries over orders, notices and credits."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank.functions import replies as rp
from coursebank.operators import analytics as an
from coursebank.operators import ledger as lg
from coursebank.plans import fixtures as fx
from coursebank.plans.registry import query
from coursebank.sources.tables import load

c = F.col

# Transfer notes: purchases, each for order 2 * event_id; every tenth arrives twice.
NOTE_COLS = """event_id AS note_id, ts, CASE event_id % 9 WHEN 4 THEN '' WHEN 5 THEN 'chuyen tien' ELSE concat('Thanh toan dh ', {code}) END AS content,
  CAST(coalesce(amount_vnd, 0) + (event_id % 5 - 2) * 600 AS DOUBLE) AS amount"""
CODE = "CAST(event_id * 2 AS {s})"
NOTES_SQL = f"""{fx.TXN_SQL}, ev AS (SELECT event_id, ts FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, ts + INTERVAL 5 MINUTE FROM events WHERE event_type = 'purchase' AND event_id % 10 = 0),
en AS (SELECT ev.*, amount_vnd FROM ev LEFT JOIN txn ON order_code = {CODE.format(s='VARCHAR')}),
notes AS (SELECT {NOTE_COLS.format(code=CODE.format(s='VARCHAR'))} FROM en),
m AS (SELECT n.*, nullif(regexp_extract(upper(content), 'DH\\s*(\\d+)', 1), '') AS code FROM notes n),
mm AS (SELECT m.*, t.user_id, t.amount_vnd AS expected, t.status AS old_status, credits_added, coalesce(amount <= 0 OR abs(amount - t.amount_vnd) <= 1000, false) AS fits FROM m LEFT JOIN txn t ON t.order_code = code),
win AS (SELECT code, min(ts) AS first_ts FROM mm WHERE fits AND old_status <> 'paid' GROUP BY code),
settled AS (SELECT note_id, ts, mm.code, user_id, amount, expected, CASE WHEN content = '' THEN 'missing_content' WHEN mm.code IS NULL THEN 'no_code' WHEN old_status IS NULL THEN 'order_not_found'
  WHEN old_status = 'paid' OR first_ts < ts THEN 'already_paid' WHEN NOT fits THEN 'amount_mismatch' ELSE 'settled' END AS outcome, credits_added FROM mm LEFT JOIN win USING (code))"""


def notes(spark, d):
    txn = fx.transactions(spark, d).select("order_code", "amount_vnd")
    buys = load(spark, d, "events").where("event_type = 'purchase'").select("event_id", "ts")
    again = buys.where("event_id % 10 = 0").withColumn("ts", c("ts") + F.expr("INTERVAL 5 MINUTE"))
    rows = buys.unionByName(again).withColumn("order_code", F.expr(CODE.format(s="STRING"))).join(txn, "order_code", "left")
    return rows.selectExpr(*fx._exprs(NOTE_COLS.format(code=CODE.format(s="STRING"))))


@query("c11_matched_transfers", f"WITH {NOTES_SQL} SELECT note_id, ts, code, expected, fits AS amount_fits FROM mm")
def c11_matched_transfers(spark, d):
    return lg.match_transfers(notes(spark, d), fx.transactions(spark, d)).select("note_id", "ts", "code", "expected", "amount_fits")


@query("k1_settlement", f"WITH {NOTES_SQL} SELECT note_id, ts, code, user_id, amount, expected, outcome, CASE WHEN outcome = 'settled' THEN credits_added ELSE 0 END AS credits FROM settled")
def k1_settlement(spark, d):
    return lg.settle_transfers(notes(spark, d), fx.transactions(spark, d))


@query("k1_orders_after", f"""WITH {NOTES_SQL}, s AS (SELECT code, ts FROM settled WHERE outcome = 'settled')
SELECT order_code, CASE WHEN s.ts IS NOT NULL THEN 'paid' ELSE status END AS status, coalesce(s.ts, paid_at) AS paid_at, CASE WHEN s.ts IS NOT NULL THEN 'bank_transfer' ELSE payment_method END AS payment_method
FROM txn LEFT JOIN s ON code = order_code""")
def k1_orders_after(spark, d):
    txn = fx.transactions(spark, d)
    return lg.apply_settlements(txn, lg.settle_transfers(notes(spark, d), txn)).select("order_code", "status", "paid_at", "payment_method")


@query("ledger", f"""WITH {NOTES_SQL} SELECT outcome, count(*) AS n, CAST(sum(CASE WHEN outcome = 'settled' THEN credits_added ELSE 0 END) AS BIGINT) AS credits FROM settled GROUP BY outcome""")
def ledger(spark, d):
    return lg.settle_transfers(notes(spark, d), fx.transactions(spark, d)).groupBy("outcome").agg(
        F.count("*").alias("n"), F.sum("credits").alias("credits"))


# Gateway notices: views and clicks, several per order.
GATE_COLS = ("event_id AS notice_id", "ts", "CAST(event_id % 4000 AS {s}) AS code", "CASE WHEN event_id % 6 = 2 THEN '24' ELSE '00' END AS response",
             "event_id % 13 <> 0 AS signed")
_GATE = ", ".join(GATE_COLS).format(s="VARCHAR")
GATE_SQL = f"""{fx.TXN_SQL}, g0 AS (SELECT {_GATE}, event_id FROM events WHERE event_type IN ('view', 'click')),
g AS (SELECT g0.*, t.status AS old_status, t.amount_vnd AS expected, t.amount_vnd + (event_id % 7 - 3) * 400 AS amount FROM g0 LEFT JOIN txn t ON order_code = code)"""


def gateway(spark, d):
    rows = load(spark, d, "events").where("event_type IN ('view', 'click')").selectExpr(
        *[x.format(s="STRING") for x in GATE_COLS], "event_id")
    txn = fx.transactions(spark, d).select(c("order_code").alias("code"), "amount_vnd")
    return rows.join(txn, "code", "left").withColumn(
        "amount", c("amount_vnd") + (c("event_id") % 7 - 3) * 400).drop("amount_vnd", "event_id")


@query("k2_gateway_notices", f"""WITH {GATE_SQL}, w AS (SELECT code, min((ts, notice_id)) AS win FROM g WHERE signed AND old_status <> 'paid' AND abs(amount - expected) <= 1000 AND response = '00' GROUP BY code),
a AS (SELECT notice_id, ts, code, response, CASE WHEN NOT signed THEN '97' WHEN old_status IS NULL THEN '01' WHEN old_status = 'paid' OR win < (ts, notice_id) THEN '02'
  WHEN abs(amount - expected) > 1000 THEN '04' ELSE '00' END AS answer FROM g LEFT JOIN w USING (code))
SELECT notice_id, ts, code, answer, CASE WHEN answer <> '00' THEN 'none' WHEN response = '00' THEN 'paid' ELSE 'failed' END AS effect FROM a""")
def k2_gateway_notices(spark, d):
    return lg.gateway_notices(gateway(spark, d), fx.transactions(spark, d))


@query("k3_gateway_returns", f"""WITH {GATE_SQL}, w AS (SELECT code, min((ts, notice_id)) AS win FROM g WHERE signed AND old_status <> 'paid' AND response = '00' GROUP BY code),
f AS (SELECT code, min((ts, notice_id)) AS fail FROM g WHERE signed AND old_status = 'pending' AND response <> '00' GROUP BY code)
SELECT notice_id, ts, code, CASE WHEN NOT signed THEN 'bad_signature' WHEN old_status IS NULL THEN 'not_found'
  WHEN response = '00' THEN CASE WHEN old_status = 'paid' OR win < (ts, notice_id) THEN 'already_paid' ELSE 'paid' END
  WHEN old_status = 'pending' AND NOT coalesce(win < (ts, notice_id), false) AND fail = (ts, notice_id) THEN 'failed' ELSE 'none' END AS effect
FROM g LEFT JOIN w USING (code) LEFT JOIN f USING (code)""")
def k3_gateway_returns(spark, d):
    return lg.gateway_returns(gateway(spark, d).drop("amount"), fx.transactions(spark, d))


@query("k4_expired", f"WITH {fx.TXN_SQL} SELECT order_code, CASE WHEN status = 'pending' AND created_at <= TIMESTAMP '1999-12-31 23:30:00' THEN 'cancelled' ELSE status END AS status FROM txn")
def k4_expired(spark, d):
    return lg.expire_pending(fx.transactions(spark, d), "2000-01-01 00:00:00").select("order_code", "status")


KINDS = ("transfer", "approve", "gateway_fail", "reject", "cancel", "expire", "return_fail", "noise")
_KIND = "CASE (event_id * 7 + user_id) % 23 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " ELSE 'cancel' END"
ORDER_EVENTS = ("CAST(event_id % 3001 AS {s}) AS order_code", "ts", "event_id AS seq", f"{_KIND} AS kind")


@query("k5_order_states", f"""WITH e AS (SELECT {", ".join(ORDER_EVENTS).format(s="VARCHAR")} FROM events),
l AS (SELECT order_code, list({{'ts': ts, 'kind': kind}} ORDER BY ts, seq) AS es FROM e GROUP BY 1),
r AS (SELECT order_code, list_reduce(es, lambda a, x: CASE WHEN a.status = 'paid' THEN a
    WHEN x.kind IN ('transfer', 'approve') THEN {{'status': 'paid', 'at': x.ts, 'kind': x.kind}}
    WHEN x.kind = 'gateway_fail' THEN {{'status': 'failed', 'at': a.at, 'kind': a.kind}}
    WHEN a.status = 'pending' AND x.kind IN ('reject', 'return_fail') THEN {{'status': 'failed', 'at': a.at, 'kind': a.kind}}
    WHEN a.status = 'pending' AND x.kind IN ('cancel', 'expire') THEN {{'status': 'cancelled', 'at': a.at, 'kind': a.kind}} ELSE a END,
  {{'status': 'pending', 'at': NULL::TIMESTAMP, 'kind': NULL::VARCHAR}}) AS s FROM l)
SELECT order_code, s.status AS status, s.at AS paid_at, s.kind AS paid_by FROM r""")
def k5_order_states(spark, d):
    return lg.replay_orders(load(spark, d, "events").selectExpr(*[x.format(s="STRING") for x in ORDER_EVENTS]))


@query("k6_adjusted_credits", f"""WITH {fx.USERS_SQL}, l AS (SELECT user_id, list(CAST(event_id % 41 - 22 AS BIGINT) ORDER BY ts, event_id) AS ds FROM events GROUP BY 1)
SELECT id AS user_id, credits, CASE WHEN ds IS NULL THEN credits ELSE list_reduce(ds, lambda a, x: greatest(0, a + x), credits % 50) END AS balance
FROM (SELECT id, credits % 50 AS credits FROM users) LEFT JOIN l ON user_id = id""")
def k6_adjusted_credits(spark, d):
    users = fx.users(spark, d).select("id", (c("credits") % 50).alias("credits"))
    deltas = load(spark, d, "events").selectExpr("user_id", "ts", "event_id AS seq", "event_id % 41 - 22 AS delta")
    return lg.adjust_credits(users, deltas)


@query("k7_admitted_jobs", f"""WITH {fx.USERS_SQL}, j AS (SELECT event_id AS job_id, user_id, ts, event_id % 30 AS requested, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 7 END AS charge FROM events),
s AS (SELECT j.*, CAST(coalesce(credits % 200, 0) AS BIGINT) AS start, row_number() OVER (PARTITION BY user_id ORDER BY ts, job_id) AS rn FROM j LEFT JOIN users u ON u.id = user_id),
l AS (SELECT user_id, any_value(start) AS start, list({{'job': job_id, 'req': requested, 'charge': charge}} ORDER BY rn) AS js FROM s GROUP BY user_id),
f AS (SELECT unnest(list_reduce(js, lambda a, x: {{'bal': CASE WHEN a.bal >= x.req THEN a.bal - x.charge ELSE a.bal END, 'out': list_append(a.out, {{'job_id': x.job, 'bal': a.bal}})}},
    {{'bal': start, 'out': []::STRUCT(job_id BIGINT, bal BIGINT)[]}}).out) AS r FROM l)
SELECT j.job_id, user_id, requested, CASE WHEN r.bal >= requested THEN charge ELSE 0 END AS charge, r.bal AS balance_before, r.bal >= requested AS admitted FROM j JOIN f ON r.job_id = j.job_id""")
def k7_admitted_jobs(spark, d):
    jobs = load(spark, d, "events").selectExpr(
        "event_id AS job_id", "user_id", "ts", "event_id % 30 AS requested",
        "CASE WHEN event_type <> 'error' THEN event_id % 7 END AS produced")
    balances = fx.users(spark, d).select(c("id").alias("user_id"), (c("credits") % 200).alias("balance"))
    return lg.admit_jobs(jobs, balances)


@query("c13_paid_within", """WITH o AS (SELECT event_id AS order_id, user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT event_id AS payment_id, user_id, ts FROM events WHERE event_type = 'purchase')
SELECT payment_id, arg_max(order_id, (o.ts, order_id)) AS order_id, count(*) AS n_orders FROM p JOIN o ON o.user_id = p.user_id AND p.ts BETWEEN o.ts AND o.ts + INTERVAL 30 MINUTE GROUP BY 1""")
def c13_paid_within(spark, d):
    ev = load(spark, d, "events")
    orders = ev.where("event_type = 'signup'").selectExpr("event_id AS order_id", "user_id", "ts")
    payments = ev.where("event_type = 'purchase'").selectExpr("event_id AS payment_id", "user_id", "ts")
    return lg.paid_within(orders, payments)


SECRET = "not-a-real-secret"


# By construction the signatures of kind 0 are wrong and the others right, one of them in capitals.
@query("h30_signature_audit", "SELECT event_id % 4 AS kind, count(*) AS n, CASE WHEN event_id % 4 = 0 THEN 0 ELSE count(*) END AS n_ok FROM events GROUP BY event_id % 4")
def h30_signature_audit(spark, d):
    params = F.create_map(
        F.lit("vnp_TxnRef"), c("event_id").cast("string"), F.lit("vnp_OrderInfo"), F.concat(F.lit("Don hang *~"), c("event_type")),
        F.lit("vnp_Amount"), (c("event_id") * 100).cast("string"), F.lit("vnp_SecureHashType"), F.lit("SHA512"))
    rows = load(spark, d, "events").select("event_id", params.alias("params"))
    good = rp.hmac_sha512(rp.signed_text(F.map_filter("params", lambda k, v: k != "vnp_SecureHashType")), SECRET)
    given = F.when(c("event_id") % 4 == 0, F.lit("00")).when(c("event_id") % 4 == 1, F.upper(good)).otherwise(good)
    return lg.audit_signatures(rows.withColumn("signature", given), SECRET).groupBy((c("event_id") % 4).alias("kind")).agg(
        F.count("*").alias("n"), F.count_if("signature_ok").alias("n_ok"))


# Deletion events: signups ask, views confirm the request made two events earlier.
def deletion_events(spark, d):
    return load(spark, d, "events").where("event_type IN ('signup', 'error', 'view')").selectExpr(
        "event_id", "ts", "concat('User', user_id % 20, '@Example.com ') AS email",
        "CASE WHEN event_type = 'view' THEN 'confirm' ELSE 'request' END AS kind", "event_id - 1 AS request_id")


# Decisions over ``ev`` in the order of times: a fold per address whose state is the last accepted request.
DELETION_FOLD = """rq AS (SELECT r.event_id, r.ts, r.email, min(k.ts) AS cat FROM ev r LEFT JOIN ev k ON k.kind = 'confirm' AND k.request_id = r.event_id AND k.ts BETWEEN r.ts AND r.ts + INTERVAL 48 HOUR
  WHERE r.kind = 'request' GROUP BY ALL),
l AS (SELECT email, list({'id': event_id, 'ts': ts, 'cat': cat} ORDER BY ts, event_id) AS es FROM rq GROUP BY 1),
f AS (SELECT email, list_reduce(es, lambda a, e: CASE WHEN a.lts >= e.ts - INTERVAL 15 MINUTE AND (a.lcat IS NULL OR a.lcat > e.ts) THEN {'lts': a.lts, 'lcat': a.lcat, 'ids': a.ids}
    ELSE {'lts': e.ts, 'lcat': e.cat, 'ids': list_append(a.ids, e.id)} END, {'lts': NULL::TIMESTAMP, 'lcat': NULL::TIMESTAMP, 'ids': []::BIGINT[]}).ids AS ids FROM l)
SELECT event_id, email, ts AS created_at, list_contains(ids, event_id) AS accepted, CASE WHEN list_contains(ids, event_id) THEN ts + INTERVAL 48 HOUR END AS expires_at,
  CASE WHEN list_contains(ids, event_id) THEN cat END AS confirmed_at FROM rq JOIN f USING (email)"""


@query("k8_deletion_requests", f"""
WITH ev AS (SELECT event_id, ts, lower('User' || (user_id % 20) || '@Example.com') AS email, CASE WHEN event_type = 'view' THEN 'confirm' ELSE 'request' END AS kind, event_id - 1 AS request_id
  FROM events WHERE event_type IN ('signup', 'error', 'view')),
{DELETION_FOLD}""")
def k8_deletion_requests(spark, d):
    return lg.deletion_requests(deletion_events(spark, d))


JOB_COLS = ("event_id % 700 AS job_id", "ts", "event_id AS seq", "CAST(event_id % 101 AS INT) AS percent", "event_type AS phase", "event_type = 'purchase' AS done")


@query("k9_job_status", f"""WITH j AS (SELECT {", ".join(JOB_COLS)} FROM events), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
SELECT job_id, ts, percent, phase, done FROM l WHERE NOT coalesce(done, false) OR ts >= TIMESTAMP '2024-01-30 23:50:00'""")
def k9_job_status(spark, d):
    return lg.job_status(load(spark, d, "events").selectExpr(*JOB_COLS), "2024-01-31 00:00:00")


@query("k14_windowed_revenue", """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS revenue FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def k14_windowed_revenue(spark, d):
    buys = load(spark, d, "events").where("event_type = 'purchase'").selectExpr("ts", "CAST(round(value * 100) AS BIGINT) AS amount")
    return lg.windowed_revenue(buys, "1 hour")


@query("d20_balance_after_settlement", f"""WITH {fx.USERS_SQL}, {fx.QA_SQL}, {NOTES_SQL},
mv AS (SELECT id AS user_id, credits AS amount FROM users UNION ALL SELECT user_id, credits_added FROM txn WHERE status = 'paid' UNION ALL SELECT user_id, credits_added FROM settled WHERE outcome = 'settled' UNION ALL SELECT user_id, -1 FROM qa)
SELECT user_id, CAST(sum(amount) AS BIGINT) AS balance FROM mv GROUP BY 1""")
def d20_balance_after_settlement(spark, d):
    txn = fx.transactions(spark, d)
    after = lg.apply_settlements(txn, lg.settle_transfers(notes(spark, d), txn))
    return an.credit_balance(fx.users(spark, d), after, fx.qa_results(spark, d))
