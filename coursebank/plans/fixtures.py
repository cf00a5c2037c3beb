"""Course tables derived from the driver's tables, in Spark and as DuckDB CTEs.

Expressions are written in the SQL common to both engines, so each fixture is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from coursebank.sources.tables import load

USERS = """
  c_custkey AS id,
  CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_name END AS username,
  CASE WHEN c_custkey % 20 = 3 THEN NULL ELSE concat(lower(c_name), '@example.com') END AS email,
  CASE WHEN c_custkey % 4 = 0 THEN concat(c_mktsegment, ' user') WHEN c_custkey % 4 = 1 THEN '' END AS display_name,
  c_acctbal >= 0 AS is_active,
  c_custkey % 100 = 0 AS is_admin,
  CAST(greatest(0, floor(c_acctbal)) AS BIGINT) AS credits,
  CAST(c_custkey % 90 AS INT) AS age_days
"""

QA = """
  concat(lpad(CAST(l_orderkey AS {s}), 15, '0'), '-', l_linenumber, '-',
         lpad(CAST(l_partkey AS {s}), 12, '0'), '-', lpad(CAST(l_suppkey AS {s}), 10, '0')) AS id,
  CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(l_orderkey AS {s}) END AS batch_id,
  o_custkey AS user_id,
  l_partkey AS document_id,
  CASE l_linenumber WHEN 1 THEN 'Bloom 1 (Nhớ)' WHEN 2 THEN 'comprehension' WHEN 3 THEN 'Bloom 3'
    WHEN 4 THEN 'Phân tích' WHEN 5 THEN 'evaluate' WHEN 6 THEN 'create' ELSE 'other' END AS bloom_level,
  concat(l_returnflag, l_linestatus) AS algorithm,
  round(l_tax * 100, 2) AS process_time,
  l_quantity / 4 AS total_points
"""

TXN = """
  o_orderkey AS id,
  CAST(o_orderkey AS {s}) AS order_code,
  o_custkey AS user_id,
  CAST(round(o_totalprice) AS BIGINT) AS amount_vnd,
  CAST(floor(round(o_totalprice) / 1000) AS BIGINT) AS credits_added,
  CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'pending' ELSE 'cancelled' END AS status,
  o_orderpriority AS payment_method,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS paid_at
"""

FEEDBACK = """
  conv_id * 100 + turn AS id,
  CASE WHEN turn % 6 = 4 THEN '  ' ELSE concat('USER', conv_id, '@Example.com') END AS email,
  CASE WHEN conv_id % 9 = 5 THEN ' ' ELSE text END AS message,
  turn % 4 = 0 AS is_read
"""

DOCS = "p_partkey AS id, p_name AS title"

USERS_SQL = f"users AS (SELECT {USERS}, TIMESTAMP '2001-08-01 00:00:00' - to_days(CAST(c_custkey % 90 AS INT)) AS created_at FROM customer)"
QA_SQL = f"qa AS (SELECT {QA.format(s='VARCHAR')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
TXN_SQL = f"txn AS (SELECT {TXN.format(s='VARCHAR')} FROM orders)"
FEEDBACK_SQL = f"feedback AS (SELECT {FEEDBACK} FROM conversations WHERE role = 'user')"
DOCS_SQL = f"docs AS (SELECT {DOCS} FROM part)"

AS_OF = "2001-08-01 00:00:00"


def _exprs(text: str) -> list[str]:
    """Split a select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, ch in enumerate(text):
        if ch == "'":
            quoted = not quoted
        elif not quoted and ch == "(":
            depth += 1
        elif not quoted and ch == ")":
            depth -= 1
        elif not quoted and depth == 0 and ch == ",":
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    created = f"timestamp_ntz'{AS_OF}' - make_dt_interval(CAST(c_custkey % 90 AS INT)) AS created_at"
    return load(spark, sf_dir, "customer").selectExpr(*_exprs(USERS), created)


def qa_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "orders")
    joined = items.join(orders, items.l_orderkey == orders.o_orderkey)
    return joined.selectExpr(*_exprs(QA.format(s="STRING")))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(*_exprs(TXN.format(s="STRING")))


def feedbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(*_exprs(FEEDBACK))


def document_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*_exprs(DOCS))
