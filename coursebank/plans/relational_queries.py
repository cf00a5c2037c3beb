"""Queries over the relational course tables (scans, filters, joins, reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import labels
from coursebank.operators import analytics as an
from coursebank.operators import relational as rel
from coursebank.plans import fixtures as fx
from coursebank.plans import store
from coursebank.plans.registry import query
from coursebank.sources.tables import load
from coursebank.session import shared_folder
from coursebank.sources import tables as tb

AT = f"TIMESTAMP '{fx.AS_OF}'"

NORMALISED = (
    "CASE WHEN bloom_level IS NULL OR bloom_level = '' THEN 'Bloom 1 (Nhớ)' "
    "WHEN trim(lower(bloom_level)) LIKE 'bloom%' AND contains(bloom_level, '(') THEN "
    "coalesce(list_extract([{labels}], try_cast(regexp_extract(lower(bloom_level), 'bloom\\s*([1-6])', 1) AS INT)), bloom_level) "
    "{keys} "
    "WHEN regexp_matches(lower(bloom_level), 'bloom\\s*\\d') THEN "
    "coalesce(list_extract([{labels}], try_cast(regexp_extract(lower(bloom_level), 'bloom\\s*([1-6])', 1) AS INT)), 'Bloom 1 (Nhớ)') "
    "ELSE bloom_level END"
).format(
    labels=", ".join(f"'{x}'" for x in lx.BLOOM_LABELS),
    keys=" ".join(f"WHEN contains(lower(bloom_level), '{k}') THEN '{lx.BLOOM_LABELS[v - 1]}'"
                  for k, v in lx.BLOOM_KEYS.items()),
)

SHOWN = ("coalesce(nullif(display_name, ''), nullif(username, ''), nullif(split_part(email, '@', 1), ''), "
         "'User ' || id)")


@query("a1_table_rows", f"""
WITH {fx.USERS_SQL}, {fx.QA_SQL}, {fx.TXN_SQL}, {fx.DOCS_SQL}, {fx.FEEDBACK_SQL}
SELECT 'users' AS table_name, count(*) AS n FROM users UNION ALL SELECT 'qa_results', count(*) FROM qa
UNION ALL SELECT 'transactions', count(*) FROM txn UNION ALL SELECT 'documents', count(*) FROM docs
UNION ALL SELECT 'feedbacks', count(*) FROM feedback""")
def a1_table_rows(spark, d):
    makers = {"users": fx.users, "qa_results": fx.qa_results, "transactions": fx.transactions,
              "documents": fx.document_titles, "feedbacks": fx.feedbacks}
    out = None
    for name, make in makers.items():
        part = make(spark, d).agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("a2_question_list", f"WITH {fx.QA_SQL} SELECT id, batch_id, user_id, document_id, bloom_level, total_points FROM qa")
def a2_question_list(spark, d):
    return tb.question_list(fx.qa_results(spark, d))


@query("a13_transactions_export", f"""
WITH {fx.USERS_SQL}, {fx.TXN_SQL}
SELECT order_code, coalesce({SHOWN.replace("id)", "u.id)").replace("|| id", "|| u.id")}, '') AS user_name,
  coalesce(u.email, '') AS user_email, amount_vnd, credits_added, status,
  coalesce(payment_method, '') AS payment_method, strftime(t.created_at, '%d/%m/%Y %H:%M') AS created,
  coalesce(strftime(paid_at, '%d/%m/%Y %H:%M'), '') AS paid
FROM txn t LEFT JOIN users u ON t.user_id = u.id
WHERE status = 'paid' AND t.created_at >= '1996-01-01' AND t.created_at < '2000-01-01'""")
def a13_transactions_export(spark, d):
    return rel.export_transactions(fx.transactions(spark, d), fx.users(spark, d), "paid", "1996-01-01", "1999-12-31")


@query("a16_backfill_names", f"""
WITH {fx.USERS_SQL} SELECT id, coalesce(display_name, username) AS display_name, CAST(NULL AS TIMESTAMP) AS terms_agreed_at
FROM users""")
def a16_backfill_names(spark, d):
    grown = tb.evolve(fx.users(spark, d), tb.COURSE_SCHEMAS["users"])
    return tb.backfill_display_names(grown).select("id", "display_name", "terms_agreed_at")


@query("b2_legacy_batch", f"""
WITH {fx.QA_SQL} SELECT bloom_level, count(*) AS n FROM qa WHERE batch_id IS NULL GROUP BY ALL""")
def b2_legacy_batch(spark, d):
    return an.count_by(rel.in_batch(fx.qa_results(spark, d), "legacy"), "bloom_level")


@query("b3_user_search", f"""
WITH {fx.USERS_SQL} SELECT id, username, email, display_name FROM users
WHERE (username ILIKE '%MER#00000001%' OR email ILIKE '%MER#00000001%' OR display_name ILIKE '%MER#00000001%') AND is_active""")
def b3_user_search(spark, d):
    return rel.search_users(fx.users(spark, d), "MER#00000001", "active").select(
        "id", "username", "email", "display_name")


@query("b4_status_filters", f"""
WITH {fx.USERS_SQL}, {fx.FEEDBACK_SQL}, {fx.TXN_SQL}
SELECT 'locked' AS filter, count(*) AS n FROM users WHERE NOT is_active
UNION ALL SELECT 'admin', count(*) FROM users WHERE is_admin
UNION ALL SELECT 'unread', count(*) FROM feedback WHERE NOT is_read
UNION ALL SELECT 'pending', count(*) FROM txn WHERE status = 'pending'""")
def b4_status_filters(spark, d):
    users = fx.users(spark, d)
    picks = {
        "locked": rel.search_users(users, status="locked"), "admin": rel.search_users(users, status="admin"),
        "unread": fx.feedbacks(spark, d).where(~F.col("is_read")),
        "pending": fx.transactions(spark, d).where(F.col("status") == "pending"),
    }
    out = None
    for name, df in picks.items():
        part = df.agg(F.count("*").alias("n")).withColumn("filter", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query("b5_date_range", f"""
WITH {fx.TXN_SQL} SELECT status, count(*) AS n, CAST(sum(amount_vnd) AS BIGINT) AS amount FROM txn
WHERE created_at >= '1997-03-01' AND created_at < '1998-07-01' GROUP BY status""")
def b5_date_range(spark, d):
    rows = rel.in_dates(fx.transactions(spark, d), "1997-03-01", "1998-06-30")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum("amount_vnd").alias("amount"))


@query("b6_rolling_filters", f"""
WITH {fx.USERS_SQL}
SELECT 0 AS days, count(*) AS n FROM users WHERE created_at >= {AT}
UNION ALL SELECT 7, count(*) FROM users WHERE created_at >= {AT} - INTERVAL 7 DAY
UNION ALL SELECT 30, count(*) FROM users WHERE created_at >= {AT} - INTERVAL 30 DAY""")
def b6_rolling_filters(spark, d):
    users, out = fx.users(spark, d), None
    for days in (0, 7, 30):
        part = rel.since(users, "created_at", fx.AS_OF, days).agg(F.count("*").alias("n")).withColumn("days", F.lit(days))
        out = part if out is None else out.unionByName(part)
    return out


@query("b7_selected_ids", f"""
WITH {fx.TXN_SQL}, ids AS (SELECT CASE WHEN event_type = 'error' THEN 'x' || user_id ELSE json_extract_string(props, '$.k') END AS raw_id FROM events)
SELECT id, order_code FROM txn WHERE id IN (SELECT try_cast(raw_id AS BIGINT) FROM ids)""")
def b7_selected_ids(spark, d):
    ids = tb.load(spark, d, "events").select(
        F.when(F.col("event_type") == "error", F.concat(F.lit("x"), F.col("user_id").cast("string")))
        .otherwise(F.get_json_object("props", "$.k")).alias("raw_id"))
    return rel.select_ids(fx.transactions(spark, d), ids).select("id", "order_code")


@query("b8_display_names", f"WITH {fx.USERS_SQL} SELECT id, {SHOWN} AS shown FROM users")
def b8_display_names(spark, d):
    c = F.col
    return fx.users(spark, d).select(
        "id", labels.display_name(c("display_name"), c("username"), c("email"), c("id")).alias("shown"))


@query("b9_clean_text", f"""
WITH {fx.FEEDBACK_SQL} SELECT id, nullif(substring(trim(message), 1, 2000), '') AS message, nullif(substring(trim(email), 1, 2000), '') AS email FROM feedback""")
def b9_clean_text(spark, d):
    return fx.feedbacks(spark, d).select(
        "id", labels.clean_text(F.col("message")).alias("message"), labels.clean_text(F.col("email")).alias("email"))


@query("b10_valid_feedback", f"""
WITH {fx.FEEDBACK_SQL} SELECT id, trim(email) AS email, length(trim(message)) AS message_chars FROM feedback
WHERE trim(email) <> '' AND trim(message) <> '' AND length(trim(email)) <= 255 AND length(trim(message)) <= 5000""")
def b10_valid_feedback(spark, d):
    return rel.valid_feedback(fx.feedbacks(spark, d)).select(
        "id", "email", F.length("message").cast("bigint").alias("message_chars"))


# Every message with the reason why it isn't stored; long ones are made by repeating the text.
_LONG = "CASE WHEN id % 5 = 0 THEN repeat(message, 30) ELSE message END"


@query("b10_checked_feedback", f"""
WITH {fx.FEEDBACK_SQL}, f AS (SELECT id, trim(email) AS email, trim({_LONG}) AS message FROM feedback)
SELECT id, email, length(message) AS message_chars, CASE WHEN coalesce(email, '') = '' THEN 'no_email' WHEN coalesce(message, '') = '' THEN 'no_message'
  WHEN length(email) > 255 THEN 'long_email' WHEN length(message) > 5000 THEN 'long_message' END AS reason FROM f""")
def b10_checked_feedback(spark, d):
    rows = fx.feedbacks(spark, d).withColumn("message", F.expr(_LONG))
    return rel.checked_feedback(rows).select("id", "email", F.length("message").cast("bigint").alias("message_chars"), "reason")


@query("b12_hidden_algorithms", f"""
WITH {fx.QA_SQL} SELECT algorithm, count(*) AS n FROM qa WHERE NOT coalesce(contains(lower(algorithm), 'ao'), false) GROUP BY ALL""")
def b12_hidden_algorithms(spark, d):
    return an.count_by(rel.hide_algorithms(fx.qa_results(spark, d), ["AO"]), "algorithm")


@query("c1_top_users", f"""
WITH {fx.USERS_SQL}, {fx.QA_SQL}
SELECT u.id, username, n AS n_questions FROM users u JOIN (SELECT user_id, count(*) AS n FROM qa GROUP BY 1) q ON u.id = user_id
ORDER BY n DESC, u.id LIMIT 10""")
def c1_top_users(spark, d):
    return rel.top_by_questions(fx.users(spark, d).select("id", "username"), fx.qa_results(spark, d), "id", "user_id", 10)


@query("c2_top_documents", f"""
WITH {fx.DOCS_SQL}, {fx.QA_SQL}
SELECT d.id, title, n AS n_questions FROM docs d JOIN (SELECT document_id, count(*) AS n FROM qa GROUP BY 1) q ON d.id = document_id
ORDER BY n DESC, d.id LIMIT 5""")
def c2_top_documents(spark, d):
    return rel.top_by_questions(fx.document_titles(spark, d), fx.qa_results(spark, d), "id", "document_id", 5)


@query("c3_transactions_with_user", f"""
WITH {fx.USERS_SQL}, {fx.TXN_SQL}
SELECT t.id, coalesce({SHOWN.replace("|| id", "|| u.id")}, '') AS user_name, coalesce(u.email, '') AS user_email, amount_vnd
FROM txn t LEFT JOIN users u ON t.user_id = u.id""")
def c3_transactions_with_user(spark, d):
    return rel.with_user(fx.transactions(spark, d), fx.users(spark, d)).select(
        "id", "user_name", "user_email", "amount_vnd")


BATCHES = "batches AS (SELECT batch_id, max(id) AS max_id, count(*) AS n_questions, max(document_id) AS document_id FROM qa GROUP BY batch_id)"


@query("c4_batch_titles", f"""
WITH {fx.QA_SQL}, {fx.DOCS_SQL}, {BATCHES}
SELECT batch_id, max_id, n_questions, document_id, coalesce(title, '') AS title FROM batches LEFT JOIN docs ON id = document_id""")
def c4_batch_titles(spark, d):
    return rel.with_document_title(an.batch_summary(fx.qa_results(spark, d)), fx.document_titles(spark, d))


def _values(rows):
    return ", ".join(f"({r[0]}, '{r[1]}', {r[2]}, {r[3]})" for r in rows)


@query("c5_resolve_package", f"""
WITH req AS (SELECT o_orderkey AS request_id, o_custkey % 14 AS package_id,
    CASE WHEN o_custkey % 14 >= 9 THEN 'subscription' ELSE 'credit' END AS package_type FROM orders),
stored AS (SELECT 'credit' AS package_type, s_suppkey AS id, s_name AS name, 10 * s_suppkey AS credits, 1000 * s_suppkey AS price_vnd
    FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'subscription', n_nationkey, n_name, 100 * n_nationkey, 9000 * n_nationkey FROM nation WHERE n_nationkey % 5 = 1),
builtin AS (SELECT * FROM (VALUES {_values(lx.CREDIT_PACKAGES + lx.SUBSCRIPTION_PACKAGES)}) v(id, name, credits, price_vnd))
SELECT request_id, package_id, r.package_type, coalesce(s.name, b.name) AS name, CAST(coalesce(s.credits, b.credits) AS BIGINT) AS credits,
  CAST(coalesce(s.price_vnd, b.price_vnd) AS BIGINT) AS price_vnd, s.id IS NOT NULL AS from_table
FROM req r LEFT JOIN stored s ON s.package_type = r.package_type AND s.id = package_id LEFT JOIN builtin b ON b.id = package_id
WHERE coalesce(s.name, b.name) IS NOT NULL""")
def c5_resolve_package(spark, d):
    requests = tb.load(spark, d, "orders").selectExpr(
        "o_orderkey AS request_id", "o_custkey % 14 AS package_id",
        "CASE WHEN o_custkey % 14 >= 9 THEN 'subscription' ELSE 'credit' END AS package_type")
    credit = tb.load(spark, d, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "10 * s_suppkey AS credits", "1000 * s_suppkey AS price_vnd",
        "s_suppkey % 2 = 0 AS is_active")
    subs = tb.load(spark, d, "nation").selectExpr(
        "CAST(n_nationkey AS BIGINT) AS id", "n_name AS name", "CAST(100 * n_nationkey AS BIGINT) AS credits",
        "CAST(9000 * n_nationkey AS BIGINT) AS price_vnd", "n_nationkey % 5 = 1 AS is_active")
    defaults = spark.createDataFrame(
        list(lx.CREDIT_PACKAGES + lx.SUBSCRIPTION_PACKAGES), "id BIGINT, name STRING, credits BIGINT, price_vnd BIGINT")
    return rel.resolve_package(requests, credit, subs, defaults)


@query("c6_documents_of_admins", f"""
WITH {fx.USERS_SQL}, {fx.TXN_SQL} SELECT id, user_id FROM txn WHERE user_id IN (SELECT id FROM users WHERE is_admin)""")
def c6_documents_of_admins(spark, d):
    admins = rel.search_users(fx.users(spark, d), status="admin").select(F.col("id").alias("user_id"))
    return rel.keep_matching(fx.transactions(spark, d), admins, ["user_id"]).select("id", "user_id")


@query("c7_users_without_payment", f"""
WITH {fx.USERS_SQL}, {fx.TXN_SQL} SELECT id FROM users WHERE id NOT IN (SELECT user_id FROM txn WHERE status = 'paid')""")
def c7_users_without_payment(spark, d):
    paid = fx.transactions(spark, d).where("status = 'paid'").select(F.col("user_id").alias("id"))
    return rel.drop_matching(fx.users(spark, d), paid, ["id"]).select("id")


@query("c7_unmigrated_passwords", f"""
WITH {fx.USERS_SQL}, prov AS (SELECT user_id FROM events WHERE event_type = 'signup')
SELECT id AS user_id, 'local' AS provider, email AS provider_email, 'h' || id AS password_hash FROM users
WHERE id % 3 <> 0 AND id NOT IN (SELECT user_id FROM prov)""")
def c7_unmigrated_passwords(spark, d):
    users = fx.users(spark, d).withColumn(
        "password_hash", F.expr("CASE WHEN id % 3 <> 0 THEN concat('h', id) END"))
    providers = tb.load(spark, d, "events").where("event_type = 'signup'").select(
        "user_id", F.lit("local").alias("provider"))
    return tb.migrate_passwords(users, providers)


@query("c8_linked_provider", f"""
WITH {fx.USERS_SQL} SELECT id, EXISTS (SELECT 1 FROM events e WHERE e.user_id = users.id AND event_type = 'signup') AS linked FROM users""")
def c8_linked_provider(spark, d):
    providers = tb.load(spark, d, "events").where("event_type = 'signup'").select(F.col("user_id").alias("id"))
    return rel.flag_existing(fx.users(spark, d), providers, ["id"], "linked").select("id", "linked")


@query("d1_dashboard", f"""
WITH {fx.USERS_SQL}, {fx.QA_SQL}, {fx.TXN_SQL}, {fx.DOCS_SQL},
u AS (SELECT count(*) AS total_users, count_if(is_active) AS active_users, count_if(NOT is_active) AS locked_users,
  count_if(is_admin) AS admin_users, count_if(created_at >= {AT}) AS users_today,
  count_if(created_at >= {AT} - INTERVAL 7 DAY) AS users_week, coalesce(sum(credits), 0) AS total_credits FROM users),
q AS (SELECT count(*) AS total_questions, count(*) AS questions_week FROM qa),
t AS (SELECT coalesce(sum(amount_vnd) FILTER (status = 'paid'), 0) AS total_revenue,
  coalesce(sum(amount_vnd) FILTER (status = 'paid' AND paid_at >= {AT} - INTERVAL 30 DAY), 0) AS revenue_month,
  count_if(status = 'paid') AS paid_orders, count_if(status = 'pending') AS pending_orders FROM txn),
dd AS (SELECT count(*) AS total_documents FROM docs)
SELECT metric, CAST(value AS BIGINT) AS value FROM (
  UNPIVOT (SELECT COLUMNS(*)::HUGEINT FROM u, q, t, dd) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def d1_dashboard(spark, d):
    return an.dashboard(fx.users(spark, d), fx.qa_results(spark, d), fx.transactions(spark, d),
                        fx.document_titles(spark, d), fx.AS_OF)


@query("d2_raw_label_counts", f"WITH {fx.QA_SQL} SELECT bloom_level, count(*) AS n FROM qa GROUP BY 1")
def d2_raw_label_counts(spark, d):
    return an.count_by(fx.qa_results(spark, d), "bloom_level")


@query("d3_bloom_distribution", f"""
WITH {fx.QA_SQL}, c AS (SELECT {NORMALISED} AS level, count(*) AS n FROM qa GROUP BY 1)
SELECT level, regexp_replace(level, '^Bloom\\s*(\\d)\\s*\\((.+)\\)\\s*$', 'Bloom \\1 · \\2') AS short_label, n, position,
  CAST(sum(n) OVER () AS BIGINT) AS total, round(100.0 * n / sum(n) OVER (), 1) AS share,
  row_number() OVER (ORDER BY n DESC, position, level DESC) = 1 AS is_top, round(100.0 * (max(n) OVER ()) / sum(n) OVER (), 1) AS top_share
FROM (SELECT *, CAST(coalesce(list_position([{", ".join(f"'{x}'" for x in lx.BLOOM_LABELS)}], level), 7) AS INTEGER) AS position FROM c)""")
def d3_bloom_distribution(spark, d):
    return an.bloom_distribution(fx.qa_results(spark, d))


@query("d4_algorithms", f"""
WITH {fx.QA_SQL} SELECT algorithm, count(*) AS n FROM qa WHERE NOT contains(lower(algorithm), 'no') GROUP BY 1""")
def d4_algorithms(spark, d):
    return an.algorithm_distribution(fx.qa_results(spark, d), ["no"])


@query("d5_avg_process_time", f"WITH {fx.QA_SQL} SELECT round(coalesce(avg(process_time), 0), 4) AS avg_process_time FROM qa")
def d5_avg_process_time(spark, d):
    return an.avg_process_time(fx.qa_results(spark, d))


@query("d6_batch_summary", f"WITH {fx.QA_SQL}, {BATCHES} SELECT * FROM batches")
def d6_batch_summary(spark, d):
    return an.batch_summary(fx.qa_results(spark, d))


@query("d7_monthly_revenue", f"""
WITH {fx.TXN_SQL}, spine AS (SELECT unnest(range(date_trunc('month', {AT}) - INTERVAL 11 MONTH, {AT} + INTERVAL 1 DAY, INTERVAL 1 MONTH)) AS m)
SELECT strftime(m, '%m/%Y') AS month, CAST(coalesce(sum(amount_vnd), 0) AS BIGINT) AS revenue
FROM spine LEFT JOIN txn ON date_trunc('month', paid_at) = m AND status = 'paid' GROUP BY m""")
def d7_monthly_revenue(spark, d):
    return an.monthly_revenue(fx.transactions(spark, d), fx.AS_OF)


@query("d16_exam_total", f"WITH {fx.QA_SQL} SELECT user_id, sum(coalesce(total_points, 0)) AS exam_points FROM qa GROUP BY 1")
def d16_exam_total(spark, d):
    return an.exam_total(fx.qa_results(spark, d), ["user_id"])


@query("d17_unread", f"WITH {fx.FEEDBACK_SQL} SELECT count(*) AS total, CAST(count_if(NOT is_read) AS BIGINT) AS unread FROM feedback")
def d17_unread(spark, d):
    return an.unread_count(fx.feedbacks(spark, d))


# Questions count on the day their line is shipped; adjustments are events moved back by 25 years, among the orders.
_ADJUST = "user_id, ts - INTERVAL {n} DAY{s} AS ts, event_id AS seq, CAST(event_id % 61 - 40 AS BIGINT) AS delta"


@query("d20_credit_balance", f"""
WITH {fx.USERS_SQL}, {fx.TXN_SQL},
m AS (SELECT user_id, paid_at AS ts, false AS floor, NULL::BIGINT AS seq, credits_added AS delta FROM txn WHERE status = 'paid'
  UNION ALL SELECT o_custkey, l_shipdate, false, NULL, -1 FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT user_id, ts, true, seq, delta FROM (SELECT {_ADJUST.format(n=9131, s="")} FROM events)),
l AS (SELECT user_id, list({{'floor': floor, 'delta': delta}} ORDER BY ts NULLS FIRST, floor, seq) AS ms FROM m GROUP BY 1)
SELECT coalesce(id, user_id) AS user_id, CAST(CASE WHEN ms IS NULL THEN credits ELSE list_reduce(ms, lambda a, x: CASE WHEN x.floor
  THEN {{'floor': true, 'delta': greatest(0, a.delta + x.delta)}} ELSE {{'floor': true, 'delta': a.delta + x.delta}} END,
  {{'floor': true, 'delta': coalesce(credits, 0)}}).delta END AS BIGINT) AS balance
FROM users FULL JOIN l ON l.user_id = id""")
def d20_credit_balance(spark, d):
    lines, orders = load(spark, d, "lineitem"), load(spark, d, "orders")
    made = lines.join(orders, lines.l_orderkey == orders.o_orderkey).selectExpr("o_custkey AS user_id", "l_shipdate AS created_at")
    adjusted = load(spark, d, "events").selectExpr(*fx._exprs(_ADJUST.format(n="'9131'", s="")))
    return an.credit_balance(fx.users(spark, d), fx.transactions(spark, d), made, adjusted)


@query("e1_visible_batches", f"""
WITH {fx.QA_SQL}, {BATCHES}, top AS (SELECT * FROM batches ORDER BY max_id DESC LIMIT 10),
r AS (SELECT qa.*, CAST(row_number() OVER (PARTITION BY qa.batch_id ORDER BY qa.id DESC) AS INTEGER) AS row_no, n_questions AS total
  FROM qa JOIN top ON qa.batch_id IS NOT DISTINCT FROM top.batch_id)
SELECT batch_id, id, document_id, bloom_level, row_no, total, total > 20 AS has_more FROM r WHERE row_no <= 20""")
def e1_visible_batches(spark, d):
    return an.visible_batches(fx.qa_results(spark, d))


@query("f1_question_page", f"""
WITH {fx.QA_SQL} SELECT id, bloom_level FROM qa ORDER BY id DESC LIMIT 50 OFFSET 40""")
def f1_question_page(spark, d):
    rows = tb.question_list(fx.qa_results(spark, d)).select("id", "bloom_level")
    return rel.page(rows, [F.desc("id")], 40, 80, 50)


@query("f1_page_info", f"""
WITH {fx.QA_SQL} SELECT count(*) AS total, count(*) > 90 AS has_more, 90 AS next_offset FROM qa""")
def f1_page_info(spark, d):
    return rel.page_info(fx.qa_results(spark, d), 40, 80, 50)


@query("f1_page_per_user", f"""
WITH {fx.QA_SQL}, r AS (SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS INTEGER) AS row_no FROM qa)
SELECT * FROM r WHERE row_no BETWEEN 6 AND 10""")
def f1_page_per_user(spark, d):
    rows = fx.qa_results(spark, d).select("user_id", "id")
    return rel.page(rows, [F.desc("id")], 5, 5, 20, ["user_id"])


@query("f3_latest_orders", f"WITH {fx.TXN_SQL} SELECT id, created_at, status FROM txn ORDER BY created_at DESC, id DESC LIMIT 20")
def f3_latest_orders(spark, d):
    return rel.latest(fx.transactions(spark, d).select("id", "created_at", "status"),
                      [F.desc("created_at"), F.desc("id")], 20)


@query("g3_first_order_per_user", f"""
WITH {fx.TXN_SQL} SELECT user_id, created_at, id, amount_vnd FROM txn
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at, id) = 1""")
def g3_first_order_per_user(spark, d):
    rows = fx.transactions(spark, d).select("user_id", "created_at", "id", "amount_vnd")
    return rel.first_per_key(rows, ["user_id"], ["created_at", "id"])


@query("g4_erasure", f"""
WITH {fx.USERS_SQL}, {fx.QA_SQL}, {fx.TXN_SQL},
docs AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 7 AS user_id FROM part),
doomed AS (SELECT id FROM users WHERE NOT is_admin AND id IN (SELECT user_id FROM events WHERE event_type = 'error')),
dd AS (SELECT id FROM docs WHERE user_id IN (SELECT id FROM doomed))
SELECT 'users' AS table_name, count(*) AS n FROM users WHERE id NOT IN (FROM doomed)
UNION ALL SELECT 'documents', count(*) FROM docs WHERE user_id NOT IN (FROM doomed)
UNION ALL SELECT 'transactions', count(*) FROM txn WHERE user_id NOT IN (FROM doomed)
UNION ALL SELECT 'qa_results', count(*) FROM qa WHERE user_id NOT IN (FROM doomed) AND document_id NOT IN (FROM dd)""")
def g4_erasure(spark, d):
    docs = tb.load(spark, d, "part").selectExpr("p_partkey AS id", "CAST(p_size AS BIGINT) * 7 AS user_id")
    tables = {"users": fx.users(spark, d), "documents": docs, "transactions": fx.transactions(spark, d),
              "qa_results": fx.qa_results(spark, d)}
    gone = tb.load(spark, d, "events").where("event_type = 'error'").select("user_id")
    out = None
    for name, df in rel.erase_users(tables, gone).items():
        part = df.agg(F.count("*").alias("n")).withColumn("table_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Who is erased: users with an error event; administrators stay.
_GONE = """doomed AS (SELECT id FROM users WHERE NOT is_admin AND id IN (SELECT user_id FROM events WHERE event_type = 'error')),
gone_docs AS (SELECT id FROM documents_t WHERE user_id IN (FROM doomed))"""


def _kept_sql(name):
    own = "(user_id IS NULL OR user_id NOT IN (FROM doomed))" if name in rel.USER_TABLES else "true"
    about = "(document_id IS NULL OR document_id NOT IN (FROM gone_docs))" if name in rel.DOCUMENT_TABLES else "true"
    return "id NOT IN (FROM doomed)" if name == "users" else f"{own} AND {about}"


def _erased(spark, d):
    source, target = shared_folder(spark, "store"), shared_folder(spark, "erased")
    store.make_store(spark, d, source)
    gone = tb.load(spark, d, "events").where("event_type = 'error'").select("user_id")
    return rel.erase_store(spark, source, target, gone), target


@query("erasure", f"WITH {store.STORE_SQL}, {_GONE} " + " UNION ALL ".join(f"{store.sql_content(x)} WHERE {_kept_sql(x)}" for x in tb.COURSE_SCHEMAS))
def erasure(spark, d):
    _, target = _erased(spark, d)
    return store.content_rows({x: tb.load_course_table(spark, f"{target}/{x}", x) for x in tb.COURSE_SCHEMAS})


@query("g4_erasure_report", f"WITH {store.STORE_SQL}, {_GONE} " + " UNION ALL ".join(
    f"SELECT '{x}' AS table_name, count(*) AS n_before, count(*) FILTER ({_kept_sql(x)}) AS n_after FROM {store.SQL_NAMES[x]}" for x in tb.COURSE_SCHEMAS))
def g4_erasure_report(spark, d):
    return _erased(spark, d)[0]


@query("a1_stored_tables", f"WITH {store.STORE_SQL} " + " UNION ALL ".join(
    f"SELECT table_name, count(*) AS n, count(DISTINCT row_key) AS n_keys, {len(tb.COURSE_SCHEMAS[x].fields)} AS n_columns FROM ({store.sql_content(x)}) GROUP BY 1" for x in tb.COURSE_SCHEMAS))
def a1_stored_tables(spark, d):
    """Every stored table through its typed scan; columns that the files lack read as NULL."""
    path = shared_folder(spark, "store")
    store.make_store(spark, d, path)
    out = None
    for name in tb.COURSE_SCHEMAS:
        df = tb.load_course_table(spark, f"{path}/{name}", name)
        part = df.agg(F.count("*").alias("n"), F.count_distinct(store.key_of(name)).alias("n_keys")).select(
            F.lit(name).alias("table_name"), "n", "n_keys", F.lit(len(df.columns)).alias("n_columns"))
        out = part if out is None else out.unionByName(part)
    return out


@query("h21_bloom_codes", f"""
WITH {fx.QA_SQL}, c AS (SELECT DISTINCT bloom_level, {NORMALISED} AS level FROM qa)
SELECT bloom_level, level, try_cast(nullif(regexp_extract(level, 'Bloom\\s*(\\d)', 1), '') AS INTEGER) AS num,
  CASE WHEN regexp_matches(level, 'Bloom\\s*\\d') THEN 'B' || regexp_extract(level, 'Bloom\\s*(\\d)', 1) ELSE level END AS code FROM c""")
def h21_bloom_codes(spark, d):
    raw = fx.qa_results(spark, d).select("bloom_level").distinct()
    level = labels.normalise_bloom(F.col("bloom_level"))
    return raw.select("bloom_level", level.alias("level")).withColumns(
        {"num": labels.bloom_number(F.col("level")), "code": labels.bloom_code(F.col("level"))})


@query("h22_points", f"""
WITH {fx.QA_SQL}, c AS (SELECT id, {NORMALISED} AS level, CASE WHEN total_points > 6 THEN total_points END AS custom FROM qa),
p AS (SELECT *, coalesce(custom, CASE substring(level, 1, 7) WHEN 'Bloom 1' THEN 1.0 WHEN 'Bloom 2' THEN 1.5 WHEN 'Bloom 3' THEN 2.0
  WHEN 'Bloom 4' THEN 2.5 WHEN 'Bloom 5' THEN 3.0 WHEN 'Bloom 6' THEN 3.5 ELSE 1.0 END) AS total_points FROM c)
SELECT id, CAST(total_points AS DOUBLE) AS total_points, CAST(floor(total_points / 0.25) AS INTEGER) AS sub_points_count,
  array_to_string(list_transform(range(1, CAST(floor(total_points / 0.25) AS BIGINT) + 1), lambda i: 'Ý ' || i || ': 0.25đ'), ' | ') AS points_breakdown FROM p""")
def h22_points(spark, d):
    custom = F.when(F.col("total_points") > 6, F.col("total_points"))
    level = labels.normalise_bloom(F.col("bloom_level"))
    return fx.qa_results(spark, d).select("id", labels.points(level, custom).alias("p")).select("id", "p.*")
