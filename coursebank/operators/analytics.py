"""Reports over users, questions, documents and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions.labels import bloom_short, normalise_bloom
from coursebank.operators.relational import hide_algorithms
from coursebank.operators.ledger import running_balance


def dashboard(users: DataFrame, qa: DataFrame, txn: DataFrame, documents: DataFrame, as_of: str) -> DataFrame:
    """Scalars of the start page as (metric, value) rows: one aggregate per table, no joins.

    Questions carry no time, so the weekly count equals the total, as in the source system.
    """
    at = F.lit(as_of).cast("timestamp_ntz")
    today = F.date_trunc("DAY", at).cast("timestamp_ntz")

    def older(col: str, days: int) -> Column:
        return F.col(col) >= at - F.expr(f"INTERVAL {days} DAY")

    paid = F.col("status") == "paid"
    parts = [
        users.agg(
            F.count("*").alias("total_users"), F.count_if("is_active").alias("active_users"),
            F.count_if(~F.col("is_active")).alias("locked_users"), F.count_if("is_admin").alias("admin_users"),
            F.count_if(F.col("created_at") >= today).alias("users_today"),
            F.count_if(older("created_at", 7)).alias("users_week"),
            F.coalesce(F.sum("credits"), F.lit(0)).alias("total_credits")),
        qa.agg(F.count("*").alias("total_questions"), F.count("*").alias("questions_week")),
        txn.agg(
            F.coalesce(F.sum(F.when(paid, F.col("amount_vnd"))), F.lit(0)).alias("total_revenue"),
            F.coalesce(F.sum(F.when(paid & older("paid_at", 30), F.col("amount_vnd"))), F.lit(0)).alias("revenue_month"),
            F.count_if(paid).alias("paid_orders"),
            F.count_if(F.col("status") == "pending").alias("pending_orders")),
        documents.agg(F.count("*").alias("total_documents")),
    ]
    rows = [p.unpivot([], p.columns, "metric", "value") for p in parts]
    out = rows[0]
    for extra in rows[1:]:
        out = out.unionByName(extra)
    return out


def count_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def bloom_distribution(qa: DataFrame, level_col: str = "bloom_level") -> DataFrame:
    """Canonical level distribution with share, rank order and the most frequent level.

    Raw labels are counted first and normalised afterwards, so the label rules run once per label.
    Total and top level are scalar subqueries over the counts: no window without a partition. One level is the top one;
    of equal counts the lowest level is, and of other labels the last by name.
    """
    raw = qa.groupBy(level_col).agg(F.count("*").alias("n"))
    levels = raw.groupBy(normalise_bloom(F.col(level_col)).alias("level")).agg(F.sum("n").alias("n"))
    known = F.array_position(F.array(*[F.lit(x) for x in lx.BLOOM_LABELS]), F.col("level"))
    position = F.when(known > 0, known).otherwise(F.lit(7)).cast("int")
    first = F.max(F.struct("n", (-position).alias("back"), "level"))
    rows = levels.withColumns({"total": levels.agg(F.sum("n")).scalar(), "first": levels.agg(first).scalar()})
    rows = rows.withColumn("top", F.col("first.n"))
    percent = lambda n: F.round(F.lit(100.0) * F.col(n) / F.greatest("total", F.lit(1)), 1)
    return rows.select(
        "level", bloom_short(F.col("level")).alias("short_label"), "n",
        position.alias("position"), "total", percent("n").alias("share"),
        (F.col("level") == F.col("first.level")).alias("is_top"), percent("top").alias("top_share"))


def algorithm_distribution(qa: DataFrame, hidden: list[str]) -> DataFrame:
    return count_by(hide_algorithms(qa, hidden), "algorithm").orderBy(F.desc("n"), "algorithm")


def avg_process_time(qa: DataFrame) -> DataFrame:
    return qa.agg(F.round(F.coalesce(F.avg("process_time"), F.lit(0.0)), 4).alias("avg_process_time"))


def batch_summary(qa: DataFrame, user: int | None = None) -> DataFrame:
    """One row per batch; rows without a batch form one batch of their own."""
    rows = qa if user is None else qa.where(F.col("user_id") == user)
    return rows.groupBy("batch_id").agg(
        F.max("id").alias("max_id"), F.count("*").alias("n_questions"), F.max("document_id").alias("document_id"))


def visible_batches(qa: DataFrame, n_batches: int = 10, n_questions: int = 20) -> DataFrame:
    """First questions of the newest batches, newest first, with total and has-more flag.

    The newest batches are a top-k of the summary, so the detail scan is cut by a join with
    ``n_batches`` rows, and ranking keeps ``n_questions`` rows per batch before it shuffles.
    """
    top = batch_summary(qa).orderBy(F.desc("max_id")).limit(n_batches).select(
        F.col("batch_id").alias("b"), F.col("n_questions").alias("total"))
    rank = F.row_number().over(W.partitionBy("batch_id").orderBy(F.desc("id")))
    rows = qa.join(top, qa.batch_id.eqNullSafe(top.b)).withColumn("row_no", rank)
    return rows.where(F.col("row_no") <= n_questions).select(
        "batch_id", "id", "document_id", "bloom_level", "row_no", "total",
        (F.col("total") > n_questions).alias("has_more"))


def monthly_revenue(txn: DataFrame, as_of: str, months: int = 12) -> DataFrame:
    """Paid amount per month for the months ending at ``as_of``; months without payments show 0."""
    at = F.lit(as_of).cast("timestamp_ntz")
    this_month = F.trunc(F.to_date(at), "MM")
    first = F.add_months(this_month, 1 - months)
    paid = txn.where(
        (F.col("status") == "paid") & (F.col("paid_at") >= first.cast("timestamp_ntz"))
        & (F.col("paid_at") < F.add_months(this_month, 1).cast("timestamp_ntz")))
    sums = paid.groupBy(F.trunc(F.to_date("paid_at"), "MM").alias("month")).agg(F.sum("amount_vnd").alias("amount"))
    spine = txn.sparkSession.range(1).select(
        F.explode(F.sequence(first, this_month, F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return spine.join(sums, "month", "left").select(
        F.date_format("month", "MM/yyyy").alias("month"), F.coalesce("amount", F.lit(0)).alias("revenue"))


def exam_total(selection: DataFrame, by: list[str]) -> DataFrame:
    return selection.groupBy(*by).agg(F.sum(F.coalesce("total_points", F.lit(0.0))).alias("exam_points"))


def unread_count(feedbacks: DataFrame) -> DataFrame:
    return feedbacks.agg(
        F.count("*").alias("total"), F.count_if(~F.coalesce("is_read", F.lit(False))).alias("unread"))


def credit_balance(users: DataFrame, txn: DataFrame, qa: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """Start credits + credits of paid orders - questions produced, per user.

    Each movement table is reduced to one row per user before the union. With ``adjustments`` (user_id, ts, seq, delta),
    which never leave a negative balance, the order of times counts: orders act when paid, questions at their
    ``created_at``.
    """
    if adjustments is not None:
        paid = txn.where(F.col("status") == "paid").select("user_id", F.col("paid_at").alias("ts"), F.col("credits_added").alias("delta"))
        used = qa.select("user_id", F.col("created_at").alias("ts"), F.lit(-1).alias("delta"))
        start = users.select(F.col("id").alias("user_id"), "credits")
        return running_balance(start, [paid, used], adjustments).select("user_id", "balance")
    paid = txn.where(F.col("status") == "paid").groupBy("user_id").agg(F.sum("credits_added").alias("amount"))
    used = qa.groupBy("user_id").agg((-F.count("*")).alias("amount"))
    start = users.select(F.col("id").alias("user_id"), F.col("credits").alias("amount"))
    return start.unionByName(paid).unionByName(used).groupBy("user_id").agg(F.sum("amount").alias("balance"))


def bleu_report(qa_eval: DataFrame, digits: int = 4) -> DataFrame:
    """Mean scores and times per model, model x level, model x document, document x chapter, and overall."""
    keys = ("model", "bloom_short", "pdf", "source_chapter")
    view = qa_eval.groupingSets(
        [["model"], ["model", "bloom_short"], ["model", "pdf"], ["pdf", "source_chapter"], []],
        *keys)
    mean = {"bleu1_ans_chapter": "bleu1", "bleu2_ans_chapter": "bleu2", "bleu4_ans_chapter": "bleu4",
            "bleu4_ans_section": "bleu4_section", "process_time_s": "seconds"}
    return view.agg(
        F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n"),
        *[F.round(F.avg(c), digits).alias(name) for c, name in mean.items()])


def bleu_matrix(qa_eval: DataFrame, metric: str, models: list[str], digits: int = 4) -> DataFrame:
    """Level x model matrix of a mean score."""
    return qa_eval.groupBy("bloom_short").pivot("model", models).agg(F.round(F.avg(metric), digits))


def success_rate(qa_eval: DataFrame, plan: DataFrame) -> DataFrame:
    """Generated against planned questions per model and over all models."""
    done = qa_eval.groupBy("model").agg(F.count("*").alias("done"))
    rows = plan.groupBy("model").agg(F.sum("target").alias("target")).join(done, "model", "left")
    total = rows.groupingSets([["model"], []], "model").agg(
        F.sum("target").alias("target"), F.sum(F.coalesce("done", F.lit(0))).alias("done"))
    rate = F.when(F.col("target") > 0, F.round(100.0 * F.col("done") / F.col("target"), 1)).otherwise(F.lit(0.0))
    return total.select("model", "target", "done", rate.alias("rate"))


def attribution_accuracy(qa_eval: DataFrame) -> DataFrame:
    """Share of answers whose best chapter is their own, by model, model x level, document x chapter."""
    keys = ("model", "bloom_short", "pdf", "source_chapter")
    view = qa_eval.groupingSets([["model"], ["model", "bloom_short"], ["pdf", "source_chapter"], []], *keys)
    return view.agg(
        F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n"),
        F.count_if("is_correct").alias("correct"),
        F.round(100.0 * F.count_if("is_correct") / F.count("*"), 1).alias("accuracy"))


def attribution_errors(qa_eval: DataFrame) -> DataFrame:
    return qa_eval.where(~F.col("is_correct")).select(
        "model", "pdf", "bloom_short", "source_chapter", "best_bleu_chapter", "best_bleu_score")


def judge_agreement(judgements: DataFrame, pred_cols: list[str], level_col: str = "sys_bloom_int") -> DataFrame:
    """Agreement of each judge with the assigned level; a missing prediction does not agree."""
    agrees = [F.coalesce(F.col(c) == F.col(level_col), F.lit(False)) for c in pred_cols]
    n = sum((a.cast("int") for a in agrees[1:]), agrees[0].cast("int"))
    out = judgements.withColumns({f"agree_{j}": a for j, a in enumerate(agrees)}).withColumn("n_agree", n)
    return out.withColumns({"is_2llm": F.col("n_agree") >= 2, "is_3llm": F.col("n_agree") == 3})


def agreement_report(judged: DataFrame, by: list[str]) -> DataFrame:
    """Histogram of agreeing judges and both accuracies per group."""
    hist = [F.count_if(F.col("n_agree") == k).alias(f"agree_{k}") for k in range(4)]
    acc = [F.round(100.0 * F.count_if(c) / F.count("*"), 1).alias(name)
           for c, name in (("is_2llm", "acc2"), ("is_3llm", "acc3"))]
    return judged.groupBy(*by).agg(F.count("*").alias("n"), *hist, *acc)


def judge_report(judged: DataFrame, n_judges: int, by: list[str]) -> DataFrame:
    """Agreement rate of each judge, optionally within groups: judges are unpivoted by ``stack``."""
    pairs = ", ".join(f"{j}, agree_{j}" for j in range(n_judges))
    long = judged.select(*by, F.expr(f"stack({n_judges}, {pairs}) AS (judge, agree)"))
    return long.groupBy("judge", *by).agg(
        F.count("*").alias("n"), F.count_if("agree").alias("agreed"),
        F.round(100.0 * F.count_if("agree") / F.count("*"), 1).alias("rate"))


def questions_per_chapter(slots: DataFrame, sections: DataFrame) -> DataFrame:
    """Questions placed in a chapter against the sections it has."""
    placed = slots.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_questions"))
    have = sections.groupBy("doc_id", "chapter").agg(F.count("*").alias("n_sections"))
    return have.join(placed, ["doc_id", "chapter"], "left").withColumn(
        "n_questions", F.coalesce("n_questions", F.lit(0)))
