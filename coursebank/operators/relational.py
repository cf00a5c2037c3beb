"""Filters, joins, paging and erasure over the course tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank.functions.labels import display_name
from coursebank.sources.tables import COURSE_SCHEMAS, load_course_table


def in_batch(df: DataFrame, key: str | None) -> DataFrame:
    """Rows of one batch; NULL or ``legacy`` names the rows without a batch."""
    wanted = F.lit(None if key in (None, "legacy") else key).cast("string")
    return df.where(F.col("batch_id").eqNullSafe(wanted))


def user_status(status: str | None) -> Column:
    known = {"active": F.col("is_active"), "locked": ~F.col("is_active"), "admin": F.col("is_admin")}
    return known.get(status or "", F.lit(True))


def search_users(users: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Case-insensitive substring search over name columns, with a status filter."""
    if q:
        like = f"%{q}%"
        users = users.where(
            F.col("username").ilike(like) | F.col("email").ilike(like) | F.col("display_name").ilike(like))
    return users.where(user_status(status))


def in_dates(df: DataFrame, date_from: str | None, date_to: str | None, col: str = "created_at") -> DataFrame:
    """Rows in ``[from, to + 1 day)``; a bound that is no date is ignored."""
    lo = F.try_to_timestamp(F.lit(date_from), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    hi = F.try_to_timestamp(F.lit(date_to), F.lit("yyyy-MM-dd")).cast("timestamp_ntz")
    day = F.expr("INTERVAL 1 DAY")
    return df.where((lo.isNull() | (F.col(col) >= lo)) & (hi.isNull() | (F.col(col) < hi + day)))


def since(df: DataFrame, col: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` days at ``as_of``; 0 days means from midnight of that day."""
    at = F.lit(as_of).cast("timestamp_ntz")
    start = F.date_trunc("DAY", at).cast("timestamp_ntz") if days == 0 else at - F.expr(f"INTERVAL {days} DAY")
    return df.where(F.col(col) >= start)


def select_ids(df: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows whose id is listed in the text column ``raw_id`` of ``ids``; texts that are no integers are skipped."""
    wanted = ids.select(F.expr("try_cast(raw_id AS BIGINT)").alias(id_col)).where(F.col(id_col).isNotNull())
    return df.join(wanted.distinct(), id_col, "left_semi")


def checked_feedback(df: DataFrame) -> DataFrame:
    """All messages, trimmed, with ``reason``: NULL for those with both fields and within their length limits."""
    clean = df.withColumns({"email": F.trim("email"), "message": F.trim("message")})
    return clean.withColumn("reason", F.when(F.coalesce("email", F.lit("")) == "", "no_email")
                            .when(F.coalesce("message", F.lit("")) == "", "no_message")
                            .when(F.length("email") > 255, "long_email").when(F.length("message") > 5000, "long_message"))


def valid_feedback(df: DataFrame) -> DataFrame:
    """The messages of ``checked_feedback`` without a reason."""
    return checked_feedback(df).where("reason IS NULL").drop("reason")


def hide_algorithms(df: DataFrame, hidden: list[str], col: str = "algorithm") -> DataFrame:
    """Drop rows whose algorithm contains a hidden text; rows without an algorithm stay."""
    for text in hidden:
        df = df.where(~F.coalesce(F.lower(col).contains(text.lower()), F.lit(False)))
    return df


def top_by_questions(dim: DataFrame, qa: DataFrame, dim_key: str, qa_key: str, k: int) -> DataFrame:
    """The ``k`` rows of ``dim`` with most questions. Counting precedes the join, so a busy key is one row there."""
    counts = qa.groupBy(F.col(qa_key).alias(dim_key)).agg(F.count("*").alias("n_questions"))
    return dim.join(counts, dim_key).orderBy(F.desc("n_questions"), F.asc(dim_key)).limit(k)


def with_user(txn: DataFrame, users: DataFrame) -> DataFrame:
    """Transactions with the buyer's display name and e-mail, '' where the user is gone."""
    buyer = users.select(
        F.col("id").alias("user_id"),
        display_name(F.col("display_name"), F.col("username"), F.col("email"), F.col("id")).alias("user_name"),
        F.col("email").alias("user_email"))
    joined = txn.join(buyer, "user_id", "left")
    return joined.withColumns({
        "user_name": F.coalesce("user_name", F.lit("")), "user_email": F.coalesce("user_email", F.lit(""))})


def export_transactions(txn: DataFrame, users: DataFrame, status: str | None = None,
                        date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows of the transaction export, formatted as text."""
    rows = in_dates(txn, date_from, date_to)
    if status:
        rows = rows.where(F.col("status") == status)
    stamp = "dd/MM/yyyy HH:mm"
    return with_user(rows, users).select(
        "order_code", "user_name", "user_email", "amount_vnd", "credits_added", "status",
        F.coalesce("payment_method", F.lit("")).alias("payment_method"),
        F.date_format("created_at", stamp).alias("created"),
        F.coalesce(F.date_format("paid_at", stamp), F.lit("")).alias("paid"))


def with_document_title(batches: DataFrame, documents: DataFrame) -> DataFrame:
    titles = documents.select(F.col("id").alias("document_id"), "title")
    return batches.join(titles, "document_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def resolve_package(requests: DataFrame, credit_packages: DataFrame, sub_packages: DataFrame,
                    defaults: DataFrame) -> DataFrame:
    """Price of each request: the active stored package of its type, else the built-in list, else no row."""
    kinds = []
    for kind, table in (("credit", credit_packages), ("subscription", sub_packages)):
        kinds.append(table.where("is_active").select(
            F.lit(kind).alias("package_type"), F.col("id").alias("package_id"),
            F.struct("name", "credits", "price_vnd").alias("stored")))
    stored = kinds[0].unionByName(kinds[1])
    builtin = defaults.select(F.col("id").alias("package_id"), F.struct("name", "credits", "price_vnd").alias("builtin"))
    found = requests.join(stored, ["package_type", "package_id"], "left").join(builtin, "package_id", "left")
    pick = found.withColumn("p", F.coalesce("stored", "builtin")).where(F.col("p").isNotNull())
    return pick.select(*requests.columns, "p.name", "p.credits", "p.price_vnd",
                       F.col("stored").isNotNull().alias("from_table"))


def keep_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_matching(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys, on, "left_anti")


def flag_existing(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """Add a boolean telling whether the key exists in ``keys``."""
    present = keys.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(present, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def page(df: DataFrame, order: list[Column], offset: int, limit: int, max_limit: int,
         partition: list[str] | None = None) -> DataFrame:
    """One page of rows. Without a partition this is a top-k; with one, a ranked group limit."""
    size = max(1, min(limit, max_limit))
    if not partition:
        return df.orderBy(*order).offset(offset).limit(size)
    rank = F.row_number().over(W.partitionBy(*partition).orderBy(*order))
    return df.withColumn("row_no", rank).where(F.col("row_no").between(offset + 1, offset + size))


def page_info(df: DataFrame, offset: int, limit: int, max_limit: int) -> DataFrame:
    """Total, has_more and next_offset of a paged list: one counting row."""
    size = max(1, min(limit, max_limit))
    return df.agg(F.count("*").alias("total")).select(
        "total", (F.col("total") > offset + size).alias("has_more"), F.lit(offset + size).alias("next_offset"))


def latest(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """First row of each key. ``min_by`` combines before the shuffle, so a key's size does not matter."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*key, "r.*")


ordered_distinct = first_per_key

def merge_positions(first: DataFrame, second: DataFrame, key: tuple[str, ...] = ("doc_id", "pos")) -> DataFrame:
    """Rows found by two searches, one per position; where both found one, the first search counts."""
    both = first.withColumn("_src", F.lit(1)).unionByName(second.withColumn("_src", F.lit(2)))
    return first_per_key(both, list(key), ["_src"]).drop("_src")


# Tables that hold a user's rows, and the columns that tie a row to a user or to a user's document.
USER_TABLES = ("documents", "qa_results", "gate_logs", "generation_logs", "evaluation_logs", "transactions",
               "feedbacks", "user_auth_providers")
DOCUMENT_TABLES = ("qa_results", "gate_logs", "generation_logs", "evaluation_logs")


def erase_users(tables: Mapping[str, DataFrame], user_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the given users' rows and without rows about their documents; administrators stay."""
    doomed = tables["users"].where(~F.coalesce("is_admin", F.lit(False))).select("id").join(
        user_ids.select(F.col("user_id").alias("id")).distinct(), "id", "left_semi")
    by_user = doomed.select(F.col("id").alias("user_id"))
    out = {"users": tables["users"].join(doomed, "id", "left_anti")}
    doomed_docs = None
    if "documents" in tables:
        doomed_docs = tables["documents"].join(by_user, "user_id", "left_semi").select(F.col("id").alias("document_id"))
    for name, df in tables.items():
        if name == "users":
            continue
        if name in USER_TABLES:
            df = df.join(by_user, "user_id", "left_anti")
        if name in DOCUMENT_TABLES and doomed_docs is not None:
            df = df.join(doomed_docs, "document_id", "left_anti")
        out[name] = df
    return out


def erase_store(spark: SparkSession, source: str, target: str, user_ids: DataFrame,
                names: tuple[str, ...] = tuple(COURSE_SCHEMAS)) -> DataFrame:
    """Erase users from all stored tables: reads ``source``, writes every table to ``target``; ``table_name``, before, after.

    The cascade is that of ``erase_users``: a user's rows, and rows about a user's documents. Rows without a user stay, as
    do administrators and unknown ids. Every table is read by its declared schema and written whole; writing again
    replaces it, so a job that failed halfway is simply run again. The users to erase are written first, so that all
    tables see the same ones.
    """
    tables = {name: load_course_table(spark, f"{source}/{name}", name) for name in names}
    chosen = f"{target}/_erased_ids"
    user_ids.select(F.col("user_id").cast("long").alias("user_id")).where("user_id IS NOT NULL").distinct().write.mode(
        "overwrite").parquet(chosen)
    kept = erase_users(tables, spark.read.schema("user_id BIGINT").parquet(chosen))
    report = None
    for name, df in kept.items():
        df.write.mode("overwrite").parquet(f"{target}/{name}")
        rows = tables[name].select(F.lit(1).alias("before"), F.lit(0).alias("after")).unionAll(
            load_course_table(spark, f"{target}/{name}", name).select(F.lit(0), F.lit(1)))
        part = rows.agg(F.coalesce(F.sum("before"), F.lit(0)).alias("n_before"), F.coalesce(F.sum("after"), F.lit(0)).alias("n_after"))
        part = part.select(F.lit(name).alias("table_name"), "n_before", "n_after")
        report = part if report is None else report.unionByName(part)
    return report
