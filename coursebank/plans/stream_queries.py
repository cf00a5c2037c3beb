"""Streaming jobs over the event files, sinks, and functions for SQL users."""

from __future__ import annotations

from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import sqlfuncs
from coursebank.operators import relational as rel
from coursebank.operators import scoring as ops
from coursebank.operators import structure as st
from coursebank.plans import fixtures as fx
from coursebank.plans import ledger_queries as lq
from coursebank.plans import scoring_fixtures as sf
from coursebank.plans import scoring_queries as qs
from coursebank.plans import text_fixtures as tf
from coursebank.plans.registry import query
from coursebank.session import shared_folder, written
from coursebank.sources import pages as pg
from coursebank.sources import sinks
from coursebank.sources.tables import load
from coursebank.streaming import ledger_stream as ls
from coursebank.streaming import stateful as sl

c = F.col


def _purchases(spark, d):
    return ls.read_events(spark, d).where("event_type = 'purchase'")


@query("k14_revenue_stream", """SELECT date_trunc('hour', ts) AS window_start, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS revenue FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def k14_revenue_stream(spark, d):
    buys = _purchases(spark, d).selectExpr("ts", "CAST(round(value * 100) AS BIGINT) AS amount")
    updates = ls.run_available(ls.revenue_stream(buys, "1 hour", "1 hour"), shared_folder(spark, "revenue"), "revenue", "update")
    return ls.latest_rows(updates, ["window_start"])


def _note_stream(spark, d):
    """Transfer notes as they arrive: every tenth is sent twice at the same time by the gateway."""
    txn = fx.transactions(spark, d).select("order_code", "amount_vnd")
    buys = _purchases(spark, d).select("event_id", "ts", F.explode(F.when(
        c("event_id") % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    rows = buys.withColumn("order_code", F.expr(lq.CODE.format(s="STRING"))).join(txn, "order_code", "left")
    return rows.selectExpr(*fx._exprs(lq.NOTE_COLS.format(code=lq.CODE.format(s="STRING"))))


@query("k13_deduped_notices", "SELECT event_id AS note_id, ts FROM events WHERE event_type = 'purchase'")
def k13_deduped_notices(spark, d):
    once = ls.dedupe_notices(_note_stream(spark, d), ["note_id"], "1 hour").select("note_id", "ts")
    return ls.run_available(once, shared_folder(spark, "notices"), "notices").drop("batch_no")


@query("k1_settlement_stream", f"WITH {lq.NOTES_SQL} SELECT code, user_id, credits_added, ts FROM settled WHERE outcome = 'settled'")
def k1_settlement_stream(spark, d):
    paid = ls.settle_stream(_note_stream(spark, d), fx.transactions(spark, d))
    return ls.latest_rows(ls.run_available(paid, shared_folder(spark, "settled"), "settled", "update"), ["code"])


# An order is given up when the watermark, the smaller of both sides' latest times less 10 minutes, passes its limit.
@query("k4_expiry_stream", """
WITH o AS (SELECT event_id AS order_id, user_id, ts FROM events WHERE event_type = 'signup'), p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase'),
w AS (SELECT least((SELECT max(ts) FROM o), (SELECT max(ts) FROM p)) - INTERVAL 10 MINUTE AS mark)
SELECT order_id, user_id, ts AS ordered_at FROM o, w WHERE ts + INTERVAL 30 MINUTE < mark
  AND NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = o.user_id AND p.ts BETWEEN o.ts AND o.ts + INTERVAL 30 MINUTE)""")
def k4_expiry_stream(spark, d):
    orders = ls.read_events(spark, d).where("event_type = 'signup'").selectExpr("event_id AS order_id", "user_id", "ts")
    payments = _purchases(spark, d).selectExpr("event_id AS payment_id", "user_id", "ts")
    late = ls.expire_stream(orders, payments)
    return ls.run_available(late, shared_folder(spark, "expired"), "expired").drop("batch_no")


@query("k9_job_status_stream", f"""WITH j AS (SELECT {", ".join(lq.JOB_COLS)} FROM events), l AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, seq DESC) = 1)
SELECT job_id, ts, percent, phase, done FROM l WHERE NOT coalesce(done, false) OR ts >= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 70 MINUTE FROM j)""")
def k9_job_status_stream(spark, d):
    board = sl.job_board(ls.read_events(spark, d).selectExpr(*lq.JOB_COLS))
    return sl.shown_jobs(ls.run_available(board, shared_folder(spark, "jobs"), "jobs", "update"))


# A confirmation belongs to the address of the request it names. Decided is what the watermark, an hour behind, has passed.
@query("k8_deletion_stream", f"""
WITH rq0 AS (SELECT event_id, ts, lower('User' || (user_id % 20) || '@Example.com') AS email FROM events WHERE event_type IN ('signup', 'error')),
ev0 AS (SELECT event_id, ts, email, 'request' AS kind, NULL::BIGINT AS request_id FROM rq0
  UNION ALL SELECT e.event_id, e.ts, r.email, 'confirm', e.event_id - 1 FROM events e JOIN rq0 r ON r.event_id = e.event_id - 1 WHERE event_type = 'view'),
ev AS (SELECT * FROM ev0 WHERE ts <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM ev0)),
{lq.DELETION_FOLD}""")
def k8_deletion_stream(spark, d):
    who = "concat('User', user_id % 20, '@Example.com ')"
    asked = load(spark, d, "events").where("event_type IN ('signup', 'error')").selectExpr("event_id AS request_id", f"{who} AS asker")
    events = ls.read_events(spark, d).where("event_type IN ('signup', 'error', 'view')").selectExpr(
        "event_id", "ts", f"{who} AS own", "CASE WHEN event_type = 'view' THEN 'confirm' ELSE 'request' END AS kind",
        "CASE WHEN event_type = 'view' THEN event_id - 1 END AS request_id").join(asked, "request_id", "left")
    events = events.withColumn("email", F.when(c("kind") == "confirm", c("asker")).otherwise(c("own")))
    updates = ls.run_available(sl.deletion_stream(events), shared_folder(spark, "deletion"), "deletion", "update")
    return sl.latest_deletions(updates)


# Notes arrive in four parts by time, but every 25th only with the last part.
_ARRIVAL = "CASE WHEN note_id % 25 = 0 THEN 3 ELSE CAST(floor((day(ts) - 1) * 4 / 31) AS INT) END"


@query("k1_reconciled", f"""WITH {lq.NOTES_SQL}, a AS (SELECT *, {_ARRIVAL} AS part FROM mm),
marks AS (SELECT part, max(ts) AS latest FROM a GROUP BY part),
z AS (SELECT a.*, coalesce(a.ts < (SELECT max(latest) FROM marks WHERE marks.part < a.part) - INTERVAL 60 MINUTE, false) AS late FROM a)
SELECT code, any_value(user_id) AS user_id, any_value(credits_added) AS credits_added, min(ts) AS ts, arg_min(note_id, (ts, note_id)) AS note_id,
  arg_min(late, (ts, note_id)) AS late FROM z WHERE fits AND old_status <> 'paid' GROUP BY code""")
def k1_reconciled(spark, d):
    txn, folder = fx.transactions(spark, d), shared_folder(spark, "reconciled")
    notes = lq.notes(spark, d).withColumns({"part": F.expr(_ARRIVAL), "ts": c("ts").cast("timestamp")})
    schema = "note_id BIGINT, ts TIMESTAMP, content STRING, amount DOUBLE"
    for part in range(4):
        notes.where(c("part") == part).drop("part").write.parquet(f"{folder}/arrived/part={part}")
        arrived = spark.readStream.schema(schema).option("basePath", f"{folder}/arrived").parquet(f"{folder}/arrived/part=*")
        ls.settle_on_time(arrived.select("note_id", "ts", "content", "amount"), txn, folder, "reconciled")
    return ls.reconcile(spark, folder, txn)


# --- sinks -----------------------------------------------------------------------------


@query("a3_corpus_listing")
def a3_corpus_listing(spark, d):
    return pg.list_corpus(spark, d, "*.parquet").select("name", "length")


_CORPUS = {"documents": "text", "benchmark": "text", "pages": "html", "conversations": "text"}


@query("a3_corpus_contents", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS name, count(*) AS n_rows, CAST(sum(coalesce(length({x}), 0)) AS BIGINT) AS n_chars FROM {t}" for t, x in _CORPUS.items()))
def a3_corpus_contents(spark, d):
    out = None
    for table, text in _CORPUS.items():
        part = pg.corpus_contents(spark.read.parquet(f"{d}/{table}.parquet"), text)
        out = part if out is None else out.unionByName(part)
    return out


@query("a10_results", f"""WITH {sf.EVALUATE_SQL} SELECT doc_id AS document_id, md5(substring(source, 1, 1000)) AS content_md5, question, md5(answer) AS answer_md5, 'Bloom ' || level AS bloom_level,
  '20240131093000' AS batch_id, CAST(0.5 + 0.5 * level AS DOUBLE) AS total_points FROM evaluated WHERE decision = 'pass'""")
def a10_results(spark, d):
    passed = ops.evaluate_qa(sf.qa_pairs(spark, d)).where("decision = 'pass'")
    path = shared_folder(spark, "results")
    rows = sinks.result_rows(passed, "2024-01-31 09:30:00")
    for _ in range(2):  # as a retry does
        sinks.write_results(rows, path)
    rows = spark.read.schema("document_id BIGINT, content STRING, question STRING, answer STRING, bloom_level STRING, total_points DOUBLE, batch_id STRING").parquet(path)
    return rows.select("document_id", F.md5("content").alias("content_md5"), "question", F.md5("answer").alias("answer_md5"),
                       "bloom_level", "batch_id", "total_points")


_STAGES_SQL = f"""gate_rows AS (WITH {tf.SECTIONS_SQL}, {sf.gate_sql()}, {sf.FEASIBLE_SQL}
  SELECT 'gate' AS stage, doc_id AS document_id, CAST(NULL AS VARCHAR) AS item, level, CASE WHEN ok THEN 'pass' ELSE 'fail' END AS decision, quality AS quality_score, reasons, title AS section_title,
    CAST(n_chars AS INTEGER) AS content_len, CAST(NULL AS DOUBLE) AS faithfulness FROM feasible),
reply_rows AS (WITH {qs.ACCEPT_SQL} SELECT 'generation', pair_id // 8, CAST(pair_id AS VARCHAR), level, CASE WHEN reject_reason IS NULL THEN 'pass' ELSE 'fail' END,
  CASE WHEN reject_reason IS NULL THEN 0.75 ELSE 0.0 END, CASE WHEN reject_reason IS NULL THEN 'generation_success' ELSE 'generation_failed ' || reject_reason END, title, NULL, NULL FROM accepted),
judged_rows AS (WITH {sf.EVALUATE_SQL} SELECT 'evaluation', pair_id // 8, CAST(pair_id AS VARCHAR), level, decision, quality,
  CASE WHEN decision = 'pass' THEN '' ELSE coalesce(hard, 'below_threshold') END, NULL, NULL, round(groundedness, 4) FROM evaluated)"""


@query("a11_decision_log", f"WITH {_STAGES_SQL} SELECT * FROM gate_rows UNION ALL SELECT * FROM reply_rows UNION ALL SELECT * FROM judged_rows")
def a11_decision_log(spark, d):
    """Logs of all three stages, each written twice, and read back as one table."""
    path, batch = shared_folder(spark, "log"), "20240131093000"
    # A stage decides once; what is written twice, as a retry does, is its log. Two stages read the pairs.
    pairs = written(sf.qa_pairs(spark, d), "pairs")
    gated = qs.gate(spark, d, "title").withColumn("content_len", c("size_chars"))
    gated = gated.select("doc_id", "level", "ceiling", "title", "content_len", "word_count", "decision", "quality", "reasons")
    replies = ops.accept_replies(qs.replies_to(pairs)).select(
        F.expr("pair_id div 8").alias("doc_id"), "pair_id", "level", "title", "required_points", "accepted", "reject_reason")
    judged = ops.evaluate_qa(pairs).select("doc_id", "pair_id", "level", "decision", "quality", "fail_reason", "groundedness", "verb")
    for name, log, rows in (("gate", sinks.gate_log, gated), ("generation", sinks.generation_log, replies),
                            ("evaluation", sinks.evaluation_log, judged)):
        decided = written(rows, name)
        for _ in range(2):
            sinks.write_log(log(decided, batch), path)
    title = F.coalesce(F.get_json_object("metrics_json", "$.section_title"), F.get_json_object("structure_summary_json", "$.section_title"))
    level = F.coalesce(F.get_json_object("metrics_json", "$.bloom_num"), F.get_json_object("structure_summary_json", "$.bloom"),
                       F.regexp_extract("target_bloom", r"(\d)", 1)).cast("int")
    return sinks.read_log(spark, path).select(
        "stage", "document_id", F.coalesce("plan_item_id", F.get_json_object("plan_summary_json", "$.plan_item_id")).alias("item"),
        level.alias("level"), "decision", "quality_score", F.array_join(F.from_json("reasons_json", "array<string>"), " ").alias("reasons"),
        title.alias("section_title"), F.get_json_object("metrics_json", "$.content_len").cast("int").alias("content_len"),
        c("source_faithfulness_score").alias("faithfulness"))


# Questions hold quotes, separators and line ends; experiments replace these by bars before they are written.
_ASKED = "concat('He said \"', l_returnflag, '\", ', chr(92), ' and; left', chr(10), '\"', l_linenumber, '\"')"


@query("a12_experiment_file", f"""SELECT l_returnflag AS model, concat('Bloom ', l_linenumber) AS bloom_level, replace({_ASKED}, chr(10), ' | ') AS question, count(*) AS n, round(max(l_extendedprice), 2) AS top
FROM lineitem GROUP BY ALL""")
def a12_experiment_file(spark, d):
    rows = load(spark, d, "lineitem").selectExpr(
        "l_returnflag AS model", "l_linestatus AS model_short", "CAST(l_partkey AS STRING) AS pdf",
        "concat('Bloom ', l_linenumber) AS bloom_level", "l_extendedprice AS best_bleu_score", "l_tax AS extra",
        f"{_ASKED} AS question")
    path = shared_folder(spark, "experiment")
    columns = ["model", "model_short", "pdf", "bloom_level", "best_bleu_score", "question"]
    sinks.write_experiment(rows.withColumn("question", sinks.one_line(c("question"))), path, columns)
    back = spark.read.option("header", True).option("escape", '"').schema(
        "model STRING, model_short STRING, pdf STRING, bloom_level STRING, best_bleu_score DOUBLE, question STRING").csv(path)
    return back.groupBy("model", "bloom_level", "question").agg(F.count("*").alias("n"), F.round(F.max("best_bleu_score"), 2).alias("top"))


# --- functions for SQL users, merged positions, direct splitting ------------------------------


@query("l_sql_functions", f"""WITH {fx.QA_SQL}, x AS (SELECT DISTINCT bloom_level, algorithm FROM qa)
SELECT bloom_level, algorithm, CASE bloom_level WHEN 'comprehension' THEN 'Bloom 2 (Hiểu)' WHEN 'Bloom 3' THEN 'Bloom 3 (Vận dụng)' WHEN 'Phân tích' THEN 'Bloom 4 (Phân tích)'
  WHEN 'evaluate' THEN 'Bloom 5 (Đánh giá)' WHEN 'create' THEN 'Bloom 6 (Sáng tạo)' ELSE bloom_level END AS level,
  try_cast(nullif(regexp_extract(bloom_level, 'Bloom\\s*(\\d)', 1), '') AS INTEGER) AS num, CASE WHEN algorithm = 'AF' THEN 1.0 ELSE 0.0 END::DOUBLE AS share FROM x""")
def l_sql_functions(spark, d):
    sqlfuncs.register(spark)
    rows = fx.qa_results(spark, d).select("bloom_level", "algorithm").distinct()
    return rows.selectExpr("bloom_level", "algorithm", "normalise_bloom(bloom_level) AS level", "bloom_number(bloom_level) AS num",
                           "token_share(algorithm, 'xy af') AS share")


@query("g5_merged_positions", f"""WITH {tf.BOOKS_SQL}, l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM books))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line AS title, CASE WHEN regexp_matches(line, '^\\d+\\.\\d+ ') THEN 'number' ELSE 'word' END AS found_by FROM l
WHERE regexp_matches(line, '^\\d+\\.\\d+ ') OR regexp_matches(line, '^(Chương|Mục|\\d+\\.\\d+) ')""")
def g5_merged_positions(spark, d):
    lines = st.explode_rows(tf.books(spark, d), F.split("text", "\n"), ("doc_id",), "pos").withColumnRenamed("s", "title")
    number = lines.where(c("title").rlike(r"^\d+\.\d+ ")).withColumn("found_by", F.lit("number"))
    word = lines.where(c("title").rlike(r"^(Chương|Mục|\d+\.\d+) ")).withColumn("found_by", F.lit("word"))
    return rel.merge_positions(number, word)


_JOINED = ("list_reduce(ps, lambda a, p: CASE WHEN a.buf IS NOT NULL AND a.size + length(p) > 2000 THEN {'done': list_append(a.done, a.buf), 'buf': p, 'size': length(p)} "
           "ELSE {'done': a.done, 'buf': concat_ws(chr(10) || chr(10), a.buf, p), 'size': a.size + length(p) + 2} END, {'done': []::VARCHAR[], 'buf': NULL::VARCHAR, 'size': 0::BIGINT})")


@query("j11_size_chunks", f"""WITH p AS (SELECT doc_id, {tf.sql_strip("replace(text, chr(10), chr(10) || chr(10))")} AS content FROM documents),
q AS (SELECT doc_id, content, list_filter(list_transform(regexp_split_to_array(content, '\\n\\s*\\n'), lambda x: {tf.sql_strip('x')}), lambda x: x <> '') AS ps FROM p),
r AS (SELECT doc_id, content, {_JOINED} AS s FROM q), t AS (SELECT doc_id, content, CASE WHEN s.buf IS NOT NULL THEN list_append(s.done, s.buf) ELSE s.done END AS packed FROM r),
u AS (SELECT doc_id, CASE WHEN length(content) <= 2000 THEN [content] WHEN len(packed) > 1 THEN packed
  ELSE list_filter(list_transform(range(0, length(content), 2000), lambda i: {tf.sql_strip('substring(content, i + 1, 2000)')}), lambda x: x <> '') END AS cs, length(content) > 2000 AS big FROM t)
SELECT doc_id, CAST(unnest(range(0, len(cs))) AS INTEGER) AS pos, CASE WHEN big THEN 'T — đoạn ' || unnest(range(1, len(cs) + 1)) || '/' || len(cs) ELSE 'T' END AS title, md5(unnest(cs)) AS content_md5 FROM u""")
def j11_size_chunks(spark, d):
    text = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    docs = load(spark, d, "documents").select("doc_id", tf.tx_strip(text).alias("text"))
    one = st.make_section(F.lit("C"), F.lit("T"), c("text"))
    rows = st.explode_sections(docs.select("doc_id", one.alias("s")).select("doc_id", st.chunk_by_size(c("s"), 2000).alias("sections")))
    return rows.select("doc_id", "pos", "title", F.md5("content").alias("content_md5"))


@query("j10_inner_headings")
def j10_inner_headings(spark, d):
    # Whole books as one section each, whose inner headings split them again.
    one = st.make_section(F.lit("C"), F.lit("T"), c("text"))
    docs = tf.books(spark, d).select("doc_id", one.alias("s"))
    rows = st.explode_sections(docs.select("doc_id", st.split_inner_headings(c("s"), 400).alias("sections")))
    return rows.select("doc_id", "pos", "title", "char_count")
