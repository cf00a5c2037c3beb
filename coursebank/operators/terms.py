"""Term and sentence profiles of sections, drafted answers and unsupported lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import text as tx
from coursebank.operators.structure import computed_once, explode_rows


def top_terms(df: DataFrame, keys: list[str], text: str, n: int, min_len: int = 4) -> DataFrame:
    """The ``n`` most frequent content words per row key; ties go to the earlier word."""
    words = explode_rows(df, tx.tokens(F.col(text), min_len), tuple(keys), "at").where(~F.col("s").isin(*lx.STOP_WORDS))
    counts = words.groupBy(*keys, F.col("s").alias("term")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first_at"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "rank", "term", "n")


def _phrases(words: Column) -> Column:
    """All two-word phrases, then all three-word phrases, lowercased."""

    def grams(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(
            F.lower(F.array_join(F.slice(words, i, n), " ")).alias("gram"), F.lit(n).alias("size")))

    return F.concat(grams(2), grams(3))


def key_phrases(df: DataFrame, key: str, text: str, k: int = 5, lead_chars: int | None = None) -> DataFrame:
    """Up to ``k`` key phrases per row: frequent phrases of the text or its lead, then frequent single words."""
    lead = F.regexp_replace(tx.lead(F.col(text), lead_chars), r"[^\p{L}\p{N}_\s]", " ")
    good = F.filter(tx.words(lead), lambda w: (
        F.length(w).between(3, 25) & ~w.rlike(r"^\d+$") & ~F.lower(w).isin(*lx.KEYWORD_STOP_WORDS)))
    # Words hold no white space, so a row's words cross the shuffle as one text; rows of one key are counted together.
    joined = df.select(key, F.array_join(good, " ").alias("words")).groupBy(key).agg(F.collect_list("words").alias("rows"))
    each = F.transform("rows", lambda r: F.filter(F.split(r, " "), lambda w: w != ""))

    def placed(items: Callable[[Column], Column]) -> Column:
        """Items of all rows of a key with their place in their own row."""
        return F.flatten(F.transform("each", lambda ws: F.transform(items(ws), lambda x, i: F.struct(
            x["gram"].alias("gram"), x["size"].alias("size"), i.alias("at")))))

    def ranked(items: Callable[[Column], Column], least: int, n: int) -> Column:
        """The ``n`` most frequent items found ``least`` times or more, ties to the earlier one. Sorted, equal items form runs."""
        def counted(s: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (
                F.get(s, i)["gram"] != F.get(s, i - 1)["gram"]) | (F.get(s, i)["size"] != F.get(s, i - 1)["size"]))
            runs = tx.bind(starts, lambda at: F.transform(at, lambda p, j: F.struct(
                (p - F.coalesce(F.get(at, j + 1), F.size(s))).alias("rank"), F.get(s, p)["at"].alias("at"),
                F.get(s, p)["gram"].alias("gram"), F.get(s, p)["size"].alias("size"))))
            return F.slice(F.array_sort(F.filter(runs, lambda r: r["rank"] <= -least)), 1, n)

        return tx.bind(F.array_sort(placed(items)), lambda s: F.when(F.size(s) > 0, counted(s)))

    one = lambda ws: F.transform(ws, lambda w: F.struct(F.lower(w).alias("gram"), F.lit(1).alias("size")))
    both = joined.select(key, each.alias("each")).select(key, ranked(_phrases, 3, 8).alias("p"), ranked(one, 5, 30).alias("w"))
    lower_start = lambda g: F.forall(F.split(g, " "), lambda w: w.rlike(r"^\p{Ll}"))
    fit = F.filter("p", lambda x: ~tx.any_hit(x["gram"], lx.KEYWORD_BLACKLIST) & ((x["size"] == 3) | lower_start(x["gram"])))
    none = both.schema["p"].dataType
    both = both.select(key, F.coalesce(fit, F.array().cast(none)).alias("p"), F.coalesce("w", F.array().cast(none)).alias("w"))
    start = F.slice(F.transform("p", lambda x: x["gram"]), 1, k)

    def add(acc: Column, x: Column) -> Column:
        taken = (F.size(acc) >= k) | F.exists(acc, lambda kw: kw.contains(x["gram"]))
        return F.when(taken, acc).otherwise(F.array_append(acc, x["gram"]))

    return computed_once(both, [key], {"phrases": F.aggregate("w", start, add)}).where(F.size("phrases") > 0)


def sentence_score(sentence: Column, position: Column, keywords: Column) -> Column:
    """Importance of a sentence: numbers, names, examples and keywords add, generic phrases subtract."""
    low, stripped = F.lower(sentence), tx.strip(sentence)
    n_words = tx.word_count(sentence)
    numbers = F.size(F.regexp_extract_all(low, F.lit(r"(\d+[.,]?\d*\s*%|\d+[.,]\d+|\d{4}|\d+ [a-zà-ỹ]+)"), F.lit(1)))
    # Possessive: a name never has to be given back, and a run of any length needs no deep stack.
    names = F.size(F.regexp_extract_all(sentence, F.lit(r"([A-ZÀ-Ỹ][a-zà-ỹ]++(?:\s++[A-ZÀ-Ỹ][a-zà-ỹ]++)++)"), F.lit(1)))
    found = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    special = F.length(sentence) - F.length(F.translate(sentence, "|*#", ""))
    length_bonus = F.when(n_words.between(30, 120), 6).when(n_words.between(20, 29) | n_words.between(121, 150), 3).otherwise(0)
    position_bonus = F.when(position < 2, 5).when(position < 5, 3).otherwise(0)
    score = (
        numbers * 10 + names * 6 + tx.hits(low, lx.EXAMPLE_MARKERS) * 8 - tx.hits(low, lx.GENERIC_SENTENCE_PHRASES) * 8
        + found * 12 + F.when(found >= 2, 8).otherwise(0) + length_bonus + position_bonus
        + tx.hits(low, lx.DEFINITION_MARKERS) * 3 - F.when(special > 3, 5).otherwise(0)
    )
    metadata = stripped.rlike("(?iu)^(?:" + "|".join(lx.METADATA_STARTS) + ")")
    return F.when(metadata, F.lit(-100)).when(n_words < 20, F.lit(0)).otherwise(score).cast("int")


def draft_sentences(text: Column) -> Column:
    """Sentences of more than 30 characters, without their closing punctuation."""
    return F.filter(F.transform(F.split(tx.strip(text), r"[.!?]+\s+"), tx.strip), lambda s: F.length(s) > 30)


def extractive_answer(sections: DataFrame, level: Column, n_points: Column) -> DataFrame:
    """Draft an answer from the sentences of a section, in equal runs under the titles of the level."""
    titles = F.create_map(*[x for lv, names in lx.ANSWER_TITLES.items() for x in (F.lit(lv), tx.lit_array(names))])
    rows = sections.withColumns({"level": level, "n_points": n_points, "sents": draft_sentences(F.col("content"))})
    rows = rows.withColumns({"titles": F.element_at(titles, F.col("level")),
                             "run": F.greatest(F.lit(2), F.floor(F.size("sents") / F.col("n_points"))).cast("int")})

    def point(i: Column) -> Column:
        name = F.coalesce(F.get(F.col("titles"), i), F.concat(F.lit("Nội dung "), (i + 1).cast("string")))
        part = F.array_join(F.slice("sents", i * F.col("run") + 1, F.col("run")), " ")
        none = F.concat(F.lit("Nội dung liên quan được trình bày trong mục '"), F.col("title"),
                        F.lit("', bao gồm các khái niệm và phương pháp cụ thể."))
        body = F.when(part != "", part).otherwise(none)
        return F.concat(F.lit("- "), name, F.lit("\n"), body, F.lit("\n"))

    answer = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_points") - 1), point), "\n")
    return rows.withColumn("answer", answer).drop("sents", "titles", "run")


def structured_answer(sentences: Column, n_points: Column, titles: Column, keywords: Column, min_chars: int = 50,
                      min_words: int = 25, picked_per_point: int = 3) -> Column:
    """Draft under titles from full sentences, those of most importance first, linked by connective words.

    Sentences that only number or announce something, and short ones, are left out. Where keywords are given and more than
    two sentences a point are left, the ``picked_per_point`` best per point are taken in the order of ``sentence_score``,
    ties by position, else all in their order. They are dealt out in equal runs of at least two; inside a run an equal
    sentence counts once. Points without a sentence are left out, so the answer may be empty.
    """
    starts = "(?iu)^(?:" + "|".join(lx.DRAFT_METADATA_STARTS) + ")"
    good = F.filter(sentences, lambda s: ~tx.strip(s).rlike(starts) & (F.length(tx.strip(s)) > min_chars) & (tx.word_count(s) >= min_words))

    def picked(kept: Column) -> Column:
        ranked = F.array_sort(F.transform(kept, lambda s, i: F.struct(
            (-sentence_score(s, i, keywords)).alias("score"), i.alias("i"), s.alias("s"))))
        best = F.transform(F.slice(ranked, 1, n_points * picked_per_point), lambda r: r["s"])
        return F.when((F.size(keywords) > 0) & (F.size(kept) > n_points * 2), best).otherwise(kept)

    def linked(part: Column) -> Column:
        words, before = tx.lit_array(lx.DRAFT_CONNECTORS), tx.lit_array(lx.DRAFT_LINKED_STARTS)

        def link(s: Column, j: Column) -> Column:
            own = F.exists(before, lambda w: tx.strip(s).startswith(w))
            return F.when(j == 0, s).when(own, F.concat(F.lit(" "), tx.strip(s))).otherwise(
                F.concat(F.lit(" "), F.get(words, (j % len(lx.DRAFT_CONNECTORS)).cast("int")), F.lit(" "), tx.strip(s)))

        return tx.strip(F.array_join(F.transform(part, link), ""))

    def points(ss: Column) -> Column:
        run = F.greatest(F.lit(2), F.floor(F.size(ss) / n_points)).cast("int")

        def point(i: Column) -> Column:
            title = F.coalesce(F.get(titles, i), F.concat(F.lit("Chi tiết bổ sung "), (i - F.size(titles) + 1).cast("string")))
            part = tx.first_of_equal(F.slice(ss, i * run + 1, run), lambda s: F.lower(tx.strip(s)))
            return tx.bind(F.filter(part, lambda s: F.length(tx.strip(s)) > 20), lambda p: F.when(
                F.size(p) > 0, F.concat(F.lit("- "), title, linked(p))).otherwise(""))

        return F.array_join(F.transform(F.sequence(F.lit(0), n_points - 1), point), "")

    return F.when(n_points > 0, tx.bind(tx.bind(good, picked), points)).otherwise("")


def unsupported_lines(answers: DataFrame, key: str, answer: str, source: str) -> DataFrame:
    """Lines of an answer with under half of their content words in the source. Lines are only reported."""
    known = F.array_distinct(tx.tokens(F.col(source), 2))
    lines = F.transform(F.split(answer, "\n"), tx.strip)
    rows = answers.select(key, known.alias("known"), lines.alias("lines"))
    stop = tx.lit_array(lx.SUPPORT_STOP_WORDS)

    def judged(line: Column, i: Column) -> Column:
        content = F.array_except(F.array_distinct(tx.tokens(line, 2)), stop)
        return tx.bind(content, lambda ws: F.struct(
            i.alias("line_no"), line.alias("line"), F.size(ws).alias("n_words"),
            F.size(F.array_intersect(ws, F.col("known"))).alias("n_known")))

    long_lines = F.filter(F.transform("lines", lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                          lambda t: ~t["x"].startswith("-") & (F.length(t["x"]) >= 20))
    found = F.filter(F.transform(long_lines, lambda t: judged(t["x"], t["i"])),
                     lambda r: (r["n_words"] > 0) & (r["n_known"] / r["n_words"] < 0.5))
    return explode_rows(rows, found, (key,), "at").select(key, "s.*")
