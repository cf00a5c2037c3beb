"""All stored course tables as files, derived from the driver's tables, in Spark and as DuckDB CTEs.

Each select list is written in the SQL common to both engines; ``{s}`` stands for the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursebank.plans import fixtures as fx
from coursebank.sources.tables import COURSE_SCHEMAS, load

_LOG = ("concat('{kind}-', event_id) AS request_id, CASE WHEN event_id % 8 <> 0 THEN user_id END AS user_id, event_id % 2500 AS document_id, CAST(event_id % 5 + 1 AS INT) AS attempt, "
        "CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'pass' END AS decision, concat('[\"', event_type, '\"]') AS reasons_json, ts AS created_at")

# Table -> source table or join, columns that the stand-in fills (the others read as NULL), filter.
TABLES: dict[str, tuple[str, str, str]] = {
    "user_auth_providers": ("customer", "c_custkey AS id, c_custkey AS user_id, CASE WHEN c_custkey % 3 = 0 THEN 'google' ELSE 'local' END AS provider, concat('p', c_custkey) AS provider_user_id", "c_custkey % 5 <> 1"),
    "documents": ("part", "p_partkey AS id, p_name AS title, concat(p_brand, '.pdf') AS filename, p_type AS content, CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS BIGINT) * 7 END AS user_id", "true"),
    "gate_logs": ("events", _LOG.format(kind="gate"), "event_type = 'view'"),
    "generation_logs": ("events", _LOG.format(kind="generation"), "event_type = 'click'"),
    "evaluation_logs": ("events", _LOG.format(kind="evaluation"), "event_type = 'error'"),
    "credit_packages": ("region", "CAST(r_regionkey AS BIGINT) AS id, r_name AS name, CAST(r_regionkey AS BIGINT) * 10 AS credits, r_regionkey <> 2 AS is_active", "true"),
    "subscription_packages": ("nation", "CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS credits", "true"),
    "feedbacks": ("conversations", "conv_id * 100 + turn AS id, text AS message, CASE WHEN conv_id % 4 <> 0 THEN conv_id * 3 END AS user_id, turn % 4 = 0 AS is_read", "role = 'user'"),
    "system_settings": ("nation", "concat('setting ', n_nationkey) AS key, n_name AS value", "n_regionkey = 1"),
}
# Columns that name a row, and what is compared of it.
KEYS = {"system_settings": "key"} | {x: "request_id" for x in ("gate_logs", "generation_logs", "evaluation_logs")}
CONTENT = {
    "users": ("username", "email", "credits", "is_admin"), "user_auth_providers": ("user_id", "provider", "provider_user_id"),
    "documents": ("title", "filename", "content", "user_id"), "qa_results": ("user_id", "document_id", "bloom_level", "algorithm"),
    "gate_logs": ("user_id", "document_id", "attempt", "decision", "reasons_json"),
    "generation_logs": ("user_id", "document_id", "attempt", "decision", "reasons_json"),
    "evaluation_logs": ("user_id", "document_id", "attempt", "decision", "reasons_json"),
    "credit_packages": ("name", "credits", "is_active"), "subscription_packages": ("name", "credits", "price_vnd"),
    "transactions": ("user_id", "order_code", "amount_vnd", "status"), "feedbacks": ("message", "user_id", "is_read"),
    "system_settings": ("value",),
}


def make_store(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Write every stored table below ``path``; files hold only the columns that the stand-in fills."""
    made: dict[str, DataFrame] = {
        "users": fx.users(spark, sf_dir).drop("age_days"), "qa_results": fx.qa_results(spark, sf_dir),
        "transactions": fx.transactions(spark, sf_dir)}
    for name, (source, columns, where) in TABLES.items():
        made[name] = load(spark, sf_dir, source).where(where).selectExpr(*fx._exprs(columns))
    for name, df in made.items():
        kinds = {f.name: f.dataType for f in COURSE_SCHEMAS[name]}
        df.select(*[F.col(x).cast(kinds[x]).alias(x) for x in df.columns]).write.parquet(f"{path}/{name}")


def key_of(name: str) -> str:
    return KEYS.get(name, "id")


def content_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``row_key`` and ``content`` (digest of what is compared) of every row of every table."""
    out = None
    for name, df in tables.items():
        shown = [F.coalesce(F.col(x).cast("string"), F.lit("-")) for x in CONTENT[name]]
        rows = df.select(F.lit(name).alias("table_name"), F.col(key_of(name)).cast("string").alias("row_key"),
                         F.md5(F.concat_ws("|", *shown)).alias("content"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _sql_tables() -> str:
    own = [f"{name}_t AS (SELECT {columns} FROM {source} WHERE {where})" for name, (source, columns, where) in TABLES.items()]
    return ",\n".join([fx.USERS_SQL, fx.QA_SQL, fx.TXN_SQL, *own])


SQL_NAMES = {"users": "users", "qa_results": "qa", "transactions": "txn"} | {name: f"{name}_t" for name in TABLES}
STORE_SQL = _sql_tables()


def sql_content(name: str) -> str:
    known = {x.split(" AS ")[-1].strip() for x in fx._exprs(TABLES[name][1])} if name in TABLES else set(CONTENT[name])
    shown = ", ".join(f"coalesce(CAST({x} AS VARCHAR), '-')" if x in known else "'-'" for x in CONTENT[name])
    return f"SELECT '{name}' AS table_name, CAST({key_of(name)} AS VARCHAR) AS row_key, md5(concat_ws('|', {shown})) AS content FROM {SQL_NAMES[name]}"
