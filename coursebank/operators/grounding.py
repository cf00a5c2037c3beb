"""Which source does a text come from: n-gram attribution over a corpus, and BLEU against chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.operators.structure import DEFAULT_CHAPTER, computed_once, explode_chapters, explode_rows, explode_sections
from coursebank.sources.tables import dealt

# Documents a block of a posting list, and blocks of one gram that a task meets together.
BLOCK_DOCS, LIST_BLOCKS = 256, 64


def gram_rows(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """(key, gram) with the distinct ``n``-grams of content words of each row."""
    grams = F.array_distinct(sc.ngrams(sc.content_tokens(tx.normalise_math(F.col(text))), n))
    return explode_rows(df, grams, (key,), "at").select(key, F.col("s").alias("gram"))


def corpus_attribution(passages: DataFrame, documents: DataFrame, n: int = 4, min_shared: int = 1,
                       passage_key: str = "item_id", doc_key: str = "doc_id") -> DataFrame:
    """Best source of each passage by shared n-grams, and how many documents share any with it.

    Every passage keeps a row; without a source it has no ``best_doc`` and 0 elsewhere. Documents and passages with the
    same wanted grams are one each. Posting lists are cut into blocks of documents: a list entry is a gram and the
    documents of one block that have it, so a gram of all documents is many short rows, dealt out by a salt, and never
    one task. The blocks' lists of a passage are counted inside one row per passage and block; no row is made for a
    passage and a document. Such a row holds at most BLOCK_DOCS entries for each gram of the passage.
    """
    wanted = gram_rows(passages, passage_key, "text", n)
    p_sets = wanted.groupBy(passage_key).agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    p_keyed = p_sets.select(passage_key, "grams", F.md5(F.array_join("grams", "\n")).alias("p_sig"))
    p_grams = _signatures(p_keyed, "p_sig")
    vocabulary = wanted.select("gram").distinct()
    found = gram_rows(documents, doc_key, "text", n).join(vocabulary, "gram", "left_semi")
    d_sets = found.groupBy(doc_key).agg(F.array_sort(F.collect_set("gram")).alias("grams"))
    d_keyed = d_sets.select(doc_key, "grams", F.md5(F.array_join("grams", "\n")).alias("d_sig"))
    classes = d_keyed.groupBy("d_sig").agg(
        F.min(doc_key).alias("rep"), F.count("*").alias("n_docs"), F.any_value("grams").alias("grams"))
    # At most about BLOCK_DOCS documents a block, whatever their number.
    n_blocks = max(1, -(-documents.count() // BLOCK_DOCS))
    classes = classes.withColumn("block", F.pmod(F.xxhash64("d_sig"), F.lit(n_blocks)))
    entry = F.struct("rep", "n_docs")
    d_grams = explode_rows(classes, "grams", ("block", "rep", "n_docs"), "at").withColumnRenamed("s", "gram")
    lists = d_grams.groupBy("gram", "block").agg(F.collect_list(entry).alias("docs"))
    spread = lists.groupBy("gram").agg(F.ceil(F.count("*") / LIST_BLOCKS).alias("salts"))
    lists = lists.join(spread, "gram").withColumn("salt", F.pmod(F.xxhash64("block"), F.col("salts")))
    asked = p_grams.join(spread, "gram").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    met = asked.select("p_sig", "gram", "salt").join(lists.select("gram", "salt", "block", "docs"), ["gram", "salt"])
    per_block = met.groupBy("p_sig", "block").agg(F.array_sort(F.flatten(F.collect_list("docs"))).alias("docs"))

    def counted(docs: Column) -> Column:
        """Runs of equal documents: how many grams each shares."""
        starts = F.filter(F.sequence(F.lit(0), F.size(docs) - 1), lambda i: (i == 0) | (F.get(docs, i)["rep"] != F.get(docs, i - 1)["rep"]))
        runs = tx.bind(starts, lambda at: F.transform(at, lambda p, j: F.struct(
            (F.coalesce(F.get(at, j + 1), F.size(docs)) - p).cast("bigint").alias("shared"), (-F.get(docs, p)["rep"]).alias("back"),
            F.get(docs, p)["n_docs"].alias("n_docs"))))
        return F.filter(runs, lambda r: r["shared"] >= min_shared)

    best = per_block.select("p_sig", counted(F.col("docs")).alias("runs")).select(
        "p_sig", F.array_max("runs").alias("top"), F.aggregate("runs", F.lit(0).cast("bigint"), lambda s, r: s + r["n_docs"]).alias("n"))
    best = best.groupBy("p_sig").agg(F.max("top").alias("top"), F.sum("n").alias("n_sources"))
    sizes = p_keyed.select(passage_key, "p_sig", F.size("grams").alias("n_grams")).join(best, "p_sig", "left")
    rows = passages.select(passage_key).join(sizes, passage_key, "left")
    shared, grams = F.coalesce("top.shared", F.lit(0)), F.coalesce("n_grams", F.lit(0))
    share = F.when(grams > 0, F.round(shared / grams, 4)).otherwise(F.lit(0.0))
    return rows.select(passage_key, (-F.col("top.back")).alias("best_doc"), shared.alias("shared"), grams.alias("n_grams"),
                       share.alias("share"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def _signatures(keyed: DataFrame, sig: str) -> DataFrame:
    """(sig, gram) of each distinct gram set."""
    sets = keyed.groupBy(sig).agg(F.any_value("grams").alias("grams"))
    return explode_rows(sets, "grams", (sig,), "at").select(sig, F.col("s").alias("gram"))


def plain_words(text: Column) -> Column:
    return tx.words(F.lower(text))


def sentence_words(text: Column) -> Column:
    """Words of each sentence of a text, in order."""
    return F.transform(tx.sentences(text), plain_words)


def wanted_words(hyp_words: Column) -> Column:
    """Distinct words of an answer that decide which sentences of a source are near to it."""
    return F.array_except(hyp_words, tx.lit_array(lx.BLEU_STOP_WORDS))


def nearest_words(sentences: Column, words: Column, wanted: Column, top_n: int | None = None) -> Column:
    """Words of the sentences, those first that share most ``wanted`` words; ties by position.

    ``sentences`` is an array of word arrays, ``words`` all words of the text, which stand in for a text without
    sentences. At most ``top_n`` sentences.
    """
    rows = F.transform(sentences, lambda ws, i: F.struct(
        (-F.size(F.array_intersect(ws, wanted))).alias("rank"), i.alias("i"), ws.alias("ws")))
    best = F.array_sort(rows) if top_n is None else F.slice(F.array_sort(rows), 1, top_n)
    return tx.bind(F.flatten(F.transform(best, lambda r: r["ws"])), lambda ws: F.when(F.size(ws) > 0, ws).otherwise(words))


def reference_words(hyp: Column, ref: Column, top_n: int | None = None, fallback_words: int | None = None) -> Column:
    """``nearest_words`` of a text to an answer, both as text; a text without sentences gives at most ``fallback_words``."""
    words = plain_words(ref) if fallback_words is None else F.slice(plain_words(ref), 1, fallback_words)
    return nearest_words(sentence_words(ref), words, wanted_words(plain_words(hyp)), top_n)


def counted_grams(words: Column, n: int) -> Column:
    """The ``n``-grams of a word array, each with the number of its occurrence, as distinct strings.

    Sorted, equal grams form runs; the k-th of a run is the gram and k. So two texts share as many of these as the
    smaller counts of their common grams add up to: the clipped matches of BLEU are one set intersection in the row.
    """
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        each = lambda at: F.transform(at, lambda p, j: F.transform(
            F.sequence(F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - p - 1),
            lambda k: F.when(k == 0, F.get(s, p)).otherwise(F.concat(F.get(s, p), F.lit("\x00"), k.cast("string")))))
        return F.when(F.size(s) > 0, F.flatten(tx.bind(starts, each))).otherwise(s)

    return tx.bind(F.array_sort(sc.ngrams(words, n)), runs)


def bleu_value(n: int, matches: list[Column], hyp_len: Column, ref_len: Column) -> Column:
    """BLEU-``n`` from the clipped matches of orders 1 to ``n``: uniform weights, smoothing method 1 (0.1 for a zero count)."""
    def log_precision(i: int) -> Column:
        m = matches[i - 1]
        return F.log(F.when(m == 0, F.lit(0.1)).otherwise(m) / F.greatest(hyp_len - (i - 1), F.lit(1)))

    brevity = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len / F.greatest(hyp_len, F.lit(1))))
    mean = sum((log_precision(i) for i in range(2, n + 1)), log_precision(1)) / n
    none = (hyp_len == 0) | (ref_len < n) | (matches[0] == 0)
    return F.when(none, F.lit(0.0)).otherwise(F.round(brevity * F.exp(mean), 4))


def _grams(words: Column, top: int) -> Column:
    return F.array(*[counted_grams(words, n) for n in range(1, top + 1)])


def _score(hyp_grams: Column, hyp_len: Column, ref: Column, orders: tuple[int, ...], prefix: str) -> Column:
    """Struct of ``ref_len`` and the scores of a reference against the grams of an answer."""
    top = max(orders)

    def of(words: Column) -> Column:
        counts = F.struct(F.size(words).alias("n"), *[
            F.size(F.array_intersect(F.get(hyp_grams, F.lit(n - 1)), counted_grams(words, n))).alias(f"m{n}") for n in range(1, top + 1)])
        return tx.bind(counts, lambda x: F.struct(
            x["n"].alias("ref_len"),
            *[bleu_value(n, [x[f"m{i}"] for i in range(1, top + 1)], hyp_len, x["n"]).alias(f"{prefix}{n}") for n in orders]))

    return tx.bind(ref, of)


def bleu_scores(pairs: DataFrame, key: list[str], hyp: str, ref: str, orders: tuple[int, ...] = (1, 2, 4),
                prefix: str = "bleu") -> DataFrame:
    """BLEU of word arrays ``hyp`` against ``ref``; every pair keeps a row, an empty side gives 0.

    Grams are counted and matched inside the row, in the time a sort takes; nothing is shuffled.
    """
    words = F.coalesce(hyp, F.array().cast("array<string>")), F.coalesce(ref, F.array().cast("array<string>"))
    rows = pairs.select(*key, tx.bind(words[0], lambda h: F.struct(
        F.size(h).alias("hyp_len"), _score(_grams(h, max(orders)), F.size(h), words[1], orders, prefix).alias("s"))).alias("s"))
    return rows.select(*key, "s.hyp_len", "s.s.*")


def read_answers(answers: DataFrame, text: str, keep: list[str], orders: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """What scoring needs of a text, once per row: ``hyp_len``, ``wanted`` words and counted ``grams``."""
    words = plain_words(F.coalesce(F.col(text), F.lit("")))
    made = tx.bind(words, lambda h: F.struct(F.size(h).alias("hyp_len"), wanted_words(h).alias("wanted"),
                                             _grams(h, max(orders)).alias("grams")))
    return computed_once(answers, keep, {"a": made}).select(*keep, "a.*")


def read_sources(sources: DataFrame, text: str, keep: list[str], fallback_words: int | None = None) -> DataFrame:
    """What scoring needs of a source, once per row: the words of its ``sentences``, and its ``words`` where it has none."""
    content = F.coalesce(F.col(text), F.lit(""))
    words = plain_words(content)
    made = tx.bind(sentence_words(content), lambda ss: F.struct(
        ss.alias("sentences"), F.when(F.size(F.flatten(ss)) == 0, words if fallback_words is None else F.slice(words, 1, fallback_words))
        .otherwise(F.array().cast("array<string>")).alias("words")))
    return computed_once(sources, keep, {"r": made}).select(*keep, "r.*")


def scored(rows: DataFrame, keep: list[str], top_n: int | None, orders: tuple[int, ...], prefix: str = "bleu") -> DataFrame:
    """Scores of rows that hold the columns of ``read_answers`` and ``read_sources``."""
    ref = nearest_words(F.col("sentences"), F.col("words"), F.col("wanted"), top_n)
    made = _score(F.col("grams"), F.col("hyp_len"), ref, orders, prefix)
    return computed_once(rows, [*keep, "hyp_len"], {"b": made}).select(*keep, "hyp_len", "b.*")


def chapter_scores(answers: DataFrame, chapters: DataFrame, top_n: int | None = None, orders: tuple[int, ...] = (1, 2, 4),
                   fallback_words: int | None = None) -> DataFrame:
    """BLEU of each answer against every chapter of its own document (an equi join on the document).

    A chapter is split into sentences once, however many answers its document has, an answer into grams once, however
    many chapters.
    """
    left = read_answers(answers, "answer", ["doc_id", "pair_id"], orders)
    right = read_sources(chapters, "content", ["doc_id", "chapter_pos", "chapter"], fallback_words)
    return scored(dealt(left.join(right, "doc_id")), ["doc_id", "pair_id", "chapter_pos", "chapter"], top_n, orders)


def attribute_chapter(scores: DataFrame, own: DataFrame | Column) -> DataFrame:
    """Best chapter of each answer by BLEU-4 (first chapter on ties) and whether it is its own.

    ``own`` has doc_id, pair_id and source_chapter, or is an aggregate over an answer's scores that names its chapter,
    which spares a second pass over them. An answer whose document has no chapter stays with its own and a score of 0.
    """
    key = ["doc_id", "pair_id"]
    best = F.max_by(F.struct("chapter", F.col("bleu4").alias("score")), F.struct(F.col("bleu4"), -F.col("chapter_pos"))).alias("b")
    if isinstance(own, Column):
        rows = scores.groupBy(*key).agg(best, own.alias("source_chapter"))
    else:
        rows = own.join(scores.groupBy(*key).agg(best), key, "left")
    chapter = F.when(F.col("b").isNull(), F.col("source_chapter")).otherwise(F.col("b.chapter"))
    return rows.select(
        *key, "source_chapter", chapter.alias("best_chapter"), F.coalesce("b.score", F.lit(0.0)).alias("best_score"),
        chapter.eqNullSafe(F.col("source_chapter")).alias("is_correct"))


def answer_report(pairs: DataFrame, sections: DataFrame, chapter_sentences: int = lx.BLEU_SENTENCES,
                  section_sentences: int = lx.BLEU_SECTION_SENTENCES) -> DataFrame:
    """The experiment's row of each pair: its texts against its own section and chapter, and the best chapter.

    ``pairs``: doc_id, pair_id, section_pos, question, answer. ``sections``: doc_id and an array ``sections`` (see
    ``structure.sectioned``). Adds BLEU-1, 2 and 4 of the answer and BLEU-4 of the question against the own chapter,
    BLEU-4 of the answer against the own section and against every chapter, and word counts. A pair without such a
    section has no own chapter: scores of 0 and NULL names. Chapters and sections are split into sentences once.
    """
    chapters = read_sources(explode_chapters(sections), "content", ["doc_id", "chapter_pos", "chapter", "content"])
    chapters = chapters.withColumn("n_chapter", F.size(plain_words(F.col("content")))).drop("content")
    parts = explode_sections(sections)
    own_names = parts.select("doc_id", F.col("pos").alias("section_pos"), F.col("title").alias("section_title"), F.col("content").alias("own"),
                             F.coalesce("chapter", F.lit(DEFAULT_CHAPTER)).alias("source_chapter"), F.size(plain_words(F.col("content"))).alias("section_words"))
    key = ["doc_id", "pair_id"]
    named = pairs.join(own_names, ["doc_id", "section_pos"], "left")
    said = read_answers(named, "answer", [*key, "source_chapter"])
    every = dealt(said.join(chapters, "doc_id"))
    every = scored(every, [*key, "source_chapter", "chapter_pos", "chapter", "n_chapter"], chapter_sentences, (1, 2, 4))
    mine = F.col("chapter") == F.col("source_chapter")
    # One aggregate gives the own chapter's scores and the best chapter.
    best = every.groupBy(*key).agg(
        F.max_by(F.struct("chapter", "bleu4"), F.struct(F.col("bleu4"), -F.col("chapter_pos"))).alias("best"),
        F.max(F.when(mine, F.struct("bleu1", "bleu2", "bleu4", "n_chapter"))).alias("mine"))
    asked = read_answers(named, "question", [*key, "source_chapter"], (4,)).join(
        chapters.withColumnRenamed("chapter", "source_chapter"), ["doc_id", "source_chapter"])
    asked = scored(dealt(asked), key, chapter_sentences, (4,), "q").select(*key, F.col("q4").alias("bleu4_q_chapter"))
    near = read_sources(dealt(named.where("own IS NOT NULL").select(*key, "own")), "own", key)
    near = scored(read_answers(pairs, "answer", key, (4,)).join(near, key), key, section_sentences, (4,), "s")
    near = near.select(*key, F.col("s4").alias("bleu4_ans_section"))
    rows = named.join(best, key, "left").join(asked, key, "left").join(near, key, "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    chapter = F.coalesce("best.chapter", "source_chapter")
    return rows.select(
        *key, "source_chapter", "section_title", *[zero(f"mine.bleu{n}").alias(f"bleu{n}_ans_chapter") for n in (1, 2, 4)],
        chapter.alias("best_bleu_chapter"), zero("best.bleu4").alias("best_bleu_score"),
        chapter.eqNullSafe(F.col("source_chapter")).alias("is_correct"), zero("bleu4_ans_section").alias("bleu4_ans_section"),
        zero("bleu4_q_chapter").alias("bleu4_q_chapter"), F.size(plain_words(F.coalesce("answer", F.lit("")))).alias("answer_words"),
        F.size(plain_words(F.coalesce("question", F.lit("")))).alias("question_words"),
        F.coalesce("mine.n_chapter", F.lit(0)).alias("chapter_words"), F.coalesce("section_words", F.lit(0)).alias("section_words"))
