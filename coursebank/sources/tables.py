"""Typed scans, light projections and additive schema changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


# Stored course tables.
COURSE_SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(id=_L, username=_S, email=_S, display_name=_S, is_active=_B, is_admin=_B, credits=_L,
                     created_at=_TS, terms_agreed_at=_TS),
    "user_auth_providers": _schema(id=_L, user_id=_L, provider=_S, provider_user_id=_S, provider_email=_S,
                                   password_hash=_S, created_at=_TS),
    "documents": _schema(id=_L, title=_S, filename=_S, content=_S, upload_date=_TS, user_id=_L),
    "qa_results": _schema(id=_S, content=_S, question=_S, answer=_S, bloom_level=_S, algorithm=_S, process_time=_D,
                          section_mapping=_S, total_points=_D, sub_points_count=_I, points_breakdown=_S, batch_id=_S,
                          learning_outcome=_S, user_id=_L, document_id=_L),
    "gate_logs": _schema(request_id=_S, user_id=_L, document_id=_L, source_type=_S, attempt=_I, extraction_method=_S,
                         decision=_S, terminal_status=_S, quality_score=_D, reasons_json=_S, metrics_json=_S,
                         created_at=_TS),
    "generation_logs": _schema(request_id=_S, user_id=_L, document_id=_L, attempt=_I, decision=_S, terminal_status=_S,
                               quality_score=_D, reasons_json=_S, structure_summary_json=_S, plan_summary_json=_S,
                               created_at=_TS),
    "evaluation_logs": _schema(request_id=_S, user_id=_L, document_id=_L, plan_item_id=_S, attempt=_I, decision=_S,
                               terminal_status=_S, quality_score=_D, reasons_json=_S, target_bloom=_S,
                               generated_bloom=_S, validated_bloom=_S, bloom_match_type=_S,
                               source_faithfulness_score=_D, scoreability_score=_D, created_at=_TS),
    "credit_packages": _schema(id=_L, name=_S, credits=_L, price_vnd=_L, is_active=_B, is_popular=_B),
    "subscription_packages": _schema(id=_L, name=_S, credits=_L, price_vnd=_L, period=_S, is_active=_B),
    "transactions": _schema(id=_L, user_id=_L, package_id=_L, sub_package_id=_L, order_code=_S, amount_vnd=_L,
                            credits_added=_L, status=_S, payment_method=_S, payos_data=_S, created_at=_TS,
                            paid_at=_TS),
    "feedbacks": _schema(id=_L, email=_S, message=_S, is_read=_B, user_id=_L, created_at=_TS),
    "system_settings": _schema(key=_S, value=_S),
}

# Driver tables, declared so that a scan never infers a schema from file footers.
DRIVER_SCHEMAS: dict[str, T.StructType] = {
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "orders": _schema(o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_TS,
                      o_orderpriority=_S),
    "lineitem": _schema(l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D, l_extendedprice=_D,
                        l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S, l_shipdate=_TS),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "events": _schema(event_id=_L, ts=_TS, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "benchmark": _schema(item_id=_L, text=_S),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; declared schema where one is known."""
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when it has fewer splits than cores.

    For work that is heavy per row. A scan with enough splits is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over several tasks a core, for heavy work on few bytes.

    After a join adaptive execution merges partitions by their bytes, and after a selection by key a scan's splits hold
    very unequal numbers of rows; neither says how much work a task has. A number of partitions that is asked for is kept.
    """
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))))


def load_course_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored course table with its declared schema; columns absent from the files read as NULL."""
    return spark.read.schema(COURSE_SCHEMAS[name]).parquet(path)


def question_list(qa: DataFrame, user: int | None = None) -> DataFrame:
    """List view of questions without the heavy text columns."""
    light = qa.select("id", "batch_id", "user_id", "document_id", "bloom_level", "total_points")
    return light if user is None else light.where(F.col("user_id") == user)


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as typed NULLs; other columns stay."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def backfill_display_names(users: DataFrame) -> DataFrame:
    """Fill a missing display name from the user name."""
    return users.withColumn("display_name", F.coalesce("display_name", "username"))


def migrate_passwords(users: DataFrame, providers: DataFrame) -> DataFrame:
    """Local provider rows for users with a stored password and no local provider yet."""
    local = providers.where(F.col("provider") == "local").select(F.col("user_id").alias("id"))
    return users.where("password_hash IS NOT NULL").join(local, "id", "left_anti").select(
        F.col("id").alias("user_id"), F.lit("local").alias("provider"),
        F.col("email").alias("provider_email"), "password_hash")
