"""Scores of questions, answers and sections as Column functions.

Points are ARRAY<STRUCT<title, content>>; token sets are arrays. No Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import text as tx
from coursebank.functions.text import any_hit, bind, hits

WORD_END = r"(?:[^\p{L}\p{N}_]|$)"


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _without(words: Column, stop) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop))


def set_share(a: Column, b: Column) -> Column:
    """Share of set ``a`` that is in ``b``."""
    return _ratio(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def jaccard(a: Column, b: Column) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def content_tokens(text: Column, k: int = 2) -> Column:
    """Words of at least ``k`` characters without stop words, in order, with repeats."""
    return _without(tx.tokens(text, k), lx.STOP_WORDS)


def word_overlap(a: Column, b: Column) -> Column:
    """Share of the words of ``a`` that occur in ``b``."""
    return F.round(bind(content_tokens(a), lambda x: set_share(x, content_tokens(b))), 4)


def source_features(source: Column, lead_chars: int | None = None) -> Column:
    """What the scores of a pair need of its source, whatever the pair: read once where many pairs share a source."""
    low = F.lower(F.coalesce(source, F.lit("")))
    return F.struct(
        F.array_distinct(content_tokens(source)).alias("words"), content_tokens(tx.normalise_math(source)).alias("tokens"),
        source_terms(source).alias("terms"), anchor_terms(source).alias("anchors"), aspect_hits(tx.lead(low, lead_chars)).alias("shown"),
        F.length(tx.strip(source)).alias("chars"), (source == "").alias("empty"))


def ngrams(tokens: Column, n: int) -> Column:
    def grams(toks: Column) -> Column:
        starts = F.when(F.size(toks) >= n, F.sequence(F.lit(1), F.size(toks) - (n - 1))).otherwise(
            F.array().cast("array<int>"))
        # Words are read by their places: a slice copies the whole array for each gram where that is a stored one.
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(toks, i + (k - 1)) for k in range(n)]))

    return bind(tokens, grams)


def ngram_share(a_tokens: Column, s_tokens: Column) -> Column:
    """Weighted share of the 1- to 4-gram sets of ``a`` found in ``s``."""
    weights = {1: 0.20, 2: 0.30, 3: 0.30, 4: 0.20}

    def score(x: Column) -> Column:
        a, s = x["a"], x["s"]
        total = set_share(a, s) * weights[1]
        for n in (2, 3, 4):
            total = total + _gram_set_share(a, s, n) * weights[n]
        return F.round(F.least(total, F.lit(1.0)), 4)

    return bind(F.struct(a_tokens.alias("a"), s_tokens.alias("s")), score)


def _gram_set_share(a: Column, s: Column, n: int) -> Column:
    return bind(ngrams(a, n), lambda g: set_share(g, ngrams(s, n)))


def ngram_groundedness(answer: Column, source: Column) -> Column:
    return ngram_share(content_tokens(tx.normalise_math(answer)), content_tokens(tx.normalise_math(source)))


def repeated_terms(tokens: Column) -> Column:
    """Distinct tokens that occur at least twice: equal neighbours after sorting."""
    return bind(F.array_sort(tokens), lambda s: F.array_distinct(
        F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))


def source_terms(source: Column) -> Column:
    """Key terms of a source: repeated words, else all words of four characters and more."""
    return bind(content_tokens(source, 3), lambda toks: bind(repeated_terms(toks), lambda rep: F.when(
        F.size(rep) > 0, rep).otherwise(F.array_distinct(F.filter(toks, lambda w: F.length(w) >= 4)))))


def concept_share(answer_tokens: Column, terms: Column) -> Column:
    """Share of answer words (with repeats) that are key terms."""
    found = F.array_intersect(answer_tokens, terms)
    matched = bind(found, lambda f: F.size(F.filter(answer_tokens, lambda w: F.array_contains(f, w))))
    return F.when(F.size(terms) == 0, F.lit(0.5)).otherwise(F.round(_ratio(matched, F.size(answer_tokens)), 4))


def concept_overlap(answer: Column, source: Column) -> Column:
    share = bind(content_tokens(answer, 3), lambda a: concept_share(a, source_terms(source)))
    return F.when((answer == "") | (source == ""), F.lit(0.0)).otherwise(share)


def anchor_terms(source: Column) -> Column:
    return F.array_distinct(content_tokens(source, 4))


def anchor_share(points: Column, terms: Column) -> Column:
    """Share of points that contain a long source term, or two shorter ones."""

    def anchored(p: Column) -> Column:
        blob = F.lower(F.concat_ws(" ", p["title"], p["content"]))
        return bind(blob, lambda b: F.exists(terms, lambda t: (F.length(t) >= 5) & b.contains(t))
                    | (F.size(F.filter(terms, lambda t: b.contains(t))) >= 2))

    return F.when(F.size(points) == 0, F.lit(0.0)).when(F.size(terms) == 0, F.lit(0.5)).otherwise(
        F.size(F.filter(points, anchored)) / F.size(points))


def anchor_ratio(points: Column, source: Column) -> Column:
    return bind(anchor_terms(source), lambda t: F.when(source == "", F.lit(0.0)).otherwise(anchor_share(points, t)))


# --- points ------------------------------------------------------------------------


def _plain(text: Column) -> Column:
    return tx.strip(F.regexp_replace(F.lower(text), r"\s+", " "))


_EDGE = " .,:;-"


def adds_info(title: Column, content: Column) -> Column:
    """Does a point's content say more than its title and filler?"""

    def judged(x: Column) -> Column:
        t, body = x["t"], x["c"]
        at = F.instr(body, t)
        rest = F.when((at > 0) & (t != ""), F.concat(
            body.substr(F.lit(1), at - 1), F.lit(" "), body.substr(at + F.length(t), F.length(body)))).otherwise(body)
        rest = F.trim(F.regexp_replace(rest, rf"^({'|'.join(lx.FILLER_HEADS)})\s+", ""), F.lit(_EDGE))
        rest = F.trim(F.regexp_replace(rest, rf"({'|'.join(lx.FILLER_TAILS)})\.?$", ""), F.lit(_EDGE))
        enough = bind(rest, lambda r: bind(
            F.size(_without(tx.tokens(r, 2), lx.STOP_WORDS + lx.FILLER_WORDS)),
            lambda n: ((F.length(r) >= 10) & (n >= 2)) | ((F.length(body) >= 35) & (n >= 3))))
        return F.when((t == "") | (body == "") | (t == body), F.lit(False)).otherwise(enough)

    return bind(F.struct(_plain(title).alias("t"), _plain(content).alias("c")), judged)


def tautology(points: Column) -> Column:
    """1 for informative points, falling with the share that only repeats its title."""

    def bad(p: Column) -> Column:
        def judged(x: Column) -> Column:
            t, c = x["t"], x["c"]
            return (
                (t == "") | (c == "") | (t == c)
                | (c.startswith(lx.SUCH_AS_FILLER) & c.contains(t))
                | ((F.length(c) <= F.length(t) + 5) & c.contains(t))
                | ~adds_info(p["title"], p["content"])
            )

        return bind(F.struct(_plain(p["title"]).alias("t"), _plain(p["content"]).alias("c")), judged)

    n = F.size(points)
    return F.when(n == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.1), F.lit(1.0) - F.size(F.filter(points, bad)) / n * 0.92))


def point_profile(p: Column) -> Column:
    """What comparing two points needs, computed once per point."""
    text = _plain(F.concat(p["title"], F.lit(" "), p["content"]))
    body = F.array_distinct(_without(tx.tokens(p["content"], 3), lx.STOP_WORDS + lx.WEAK_CONTENT_WORDS))
    head = F.array_distinct(_without(tx.tokens(p["title"], 3), lx.WEAK_TITLE_WORDS))
    return F.struct(text.alias("text"), tx.words(text).alias("words"), body.alias("body"), head.alias("head"))


def _shared_phrase(a: Column, b: Column) -> Column:
    """Score of the longest phrase of 5 to 2 words of ``a`` found in ``b``."""

    def telling(phrase: Column) -> Column:
        return ((F.length(phrase) >= 8) & ~phrase.isin(*lx.GENERIC_PHRASES) & b["text"].contains(phrase)
                & F.exists(F.split(phrase, " "), lambda w: (F.length(w) >= 4) & ~w.isin(*lx.STOP_WORDS)))

    by_length = [F.length(F.get(F.filter(ngrams(a["words"], n), telling), F.lit(0))) for n in (5, 4, 3, 2)]
    return F.least(F.lit(1.0), F.coalesce(*by_length, F.lit(0)) / 28)


def pair_overlap(a: Column, b: Column) -> Column:
    """How far two point profiles say the same, 0 to 1."""
    body, head = jaccard(a["body"], b["body"]), jaccard(a["head"], b["head"])
    shared = F.size(F.filter(F.array_intersect(a["body"], b["body"]), lambda w: F.length(w) >= 5))
    measures = F.struct(_shared_phrase(a, b).alias("phrase"), body.alias("body"), head.alias("head"),
                        F.least(F.lit(0.55), shared * 0.22).alias("theme"))

    def score(m: Column) -> Column:
        raised = F.greatest(
            m["phrase"], F.when(m["body"] >= 0.38, m["body"] * 0.82), F.when(m["head"] >= 0.55, m["head"] * 0.40),
            F.when(m["theme"] >= 0.30, m["theme"]))
        apart = (F.size(a["head"]) > 0) & (F.size(b["head"]) > 0) & (m["head"] < 0.32)
        return F.round(F.least(F.when(apart, F.round(raised * 0.58, 4)).otherwise(raised), F.lit(1.0)), 4)

    return F.when((a["text"] == "") | (b["text"] == ""), F.lit(0.0)).otherwise(bind(measures, score))


def max_point_overlap(points: Column) -> Column:
    """Largest overlap of any two points of one answer, 0 for fewer than two."""

    def pairs(ps: Column) -> Column:
        return F.flatten(F.transform(ps, lambda a, i: F.transform(
            F.slice(ps, i + 2, F.greatest(F.size(ps) - i - 1, F.lit(0))), lambda b: pair_overlap(a, b))))

    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(
        F.array_max(bind(F.transform(points, point_profile), pairs)))


def diversity(overlap: Column, n_points: Column) -> Column:
    """Diversity of an answer from its largest point overlap."""
    one = F.lit(1.0)
    score = (
        F.when(n_points < 2, one).when(overlap >= 0.72, F.lit(0.20))
        .when(overlap >= 0.55, F.greatest(F.lit(0.30), F.lit(0.98) - overlap * 0.80))
        .when(overlap >= 0.40, F.greatest(F.lit(0.45), one - overlap * 0.60))
        .when(overlap >= 0.28, F.greatest(F.lit(0.58), F.lit(0.95) - overlap * 0.50))
        .otherwise(F.greatest(F.lit(0.78), one - overlap * 0.35))
    )
    return F.round(score, 4)


# --- rules per level; ``q`` and ``a`` are lowercased ----------------------------------------


def by_level(level: Column, values: dict[int, Column], otherwise: Column | None = None) -> Column:
    items = list(values.items())
    out = F.when(level == items[0][0], items[0][1])
    for key, value in items[1:]:
        out = out.when(level == key, value)
    return out if otherwise is None else out.otherwise(otherwise)


def verb_score(q: Column, level: Column) -> Column:
    found = by_level(level, {k: any_hit(q, v) for k, v in lx.LEVEL_VERBS.items()}, F.lit(False))
    return F.when(found, F.lit(0.90)).otherwise(F.lit(0.35))


def _rule(score: float, reason: str) -> Column:
    return F.struct(F.lit(False).alias("ok"), F.lit(score).alias("score"), F.lit(reason).alias("reason"))


def _passed(score: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), score.alias("score"), F.lit("ok").alias("reason"))


def level3_drift(q: Column) -> Column:
    return q.rlike("(?:" + "|".join(lx.LEVEL3_DRIFT) + ")" + WORD_END)


def scenario_score(q: Column) -> Column:
    """Is a level 3 question set in a situation, and does it ask to apply something?"""
    verb, scene = any_hit(q, lx.LEVEL3_VERBS), any_hit(q, lx.LEVEL3_SCENARIOS)
    return (F.when(level3_drift(q), F.lit(0.25)).when(verb & scene, F.lit(1.0)).when(verb, F.lit(0.58))
            .when(scene, F.lit(0.50)).otherwise(F.lit(0.38)))


def question_rule(q: Column, level: Column) -> Column:
    """STRUCT(ok, score, reason): does a question stay on its level? Levels 4 to 6 always do."""

    def rules(q: Column) -> Column:
        off_start = q.rlike("^(phân tích|đánh giá|so sánh)" + WORD_END)
        rule1 = (
            F.when(any_hit(q, lx.LEVEL1_OFF_LEVEL), _rule(0.12, "off_level"))
            .when(off_start, _rule(0.15, "off_level_start"))
            .when(F.concat(F.lit(" "), q).contains(" tại sao"), _rule(0.15, "asks_why"))
            .when(~any_hit(q, lx.LEVEL1_VERBS), _rule(0.22, "verb_missing")).otherwise(_passed(F.lit(0.95)))
        )
        rule2 = (
            F.when(any_hit(q, lx.LEVEL2_OFF_LEVEL), _rule(0.18, "off_level"))
            .when(off_start, _rule(0.15, "off_level_start"))
            .when(~any_hit(q, lx.LEVEL2_VERBS), _rule(0.22, "verb_missing")).otherwise(_passed(F.lit(0.95)))
        )
        rule3 = (
            F.when(any_hit(q, lx.LEVEL3_OFF_LEVEL), _rule(0.15, "off_level"))
            .when(any_hit(q, lx.LEVEL3_META), _rule(0.12, "meta"))
            .when(level3_drift(q), _rule(0.20, "describes_only")).otherwise(_passed(scenario_score(q)))
        )
        return by_level(level, {1: rule1, 2: rule2, 3: rule3}, _passed(F.lit(1.0)))

    return bind(tx.strip(q), rules)


def step_answer_rule(a: Column, points: Column) -> Column:
    """STRUCT(ok, reason): level 3 answers must not be meta text or a template of analysis titles."""
    step = r"^bước\s*\d+\s*(.*)$"

    def template(t: Column) -> Column:
        named = t.rlike(f"^(?:{'|'.join(lx.LEVEL3_FORBIDDEN_TITLES)})(?::| |\\z)")
        started = t.rlike(f"^(?:{'|'.join(lx.LEVEL3_TITLE_STARTS)})")
        return ~t.rlike(step) & (named | started)

    def bare_step(t: Column) -> Column:
        bare = tx.strip(F.regexp_extract(t, step, 1))
        return t.rlike(step) & (bare.isin(*lx.LEVEL3_BARE_TITLES) | bare.startswith(lx.LEVEL3_TITLE_STARTS[0]))

    def reason(titles: Column) -> Column:
        n = F.size(titles)
        return (
            F.when(n == 0, "no_points").when(any_hit(a, lx.ANSWER_META), "meta")
            .when(F.exists(titles, template), "template_title")
            .when(F.size(F.filter(titles, bare_step)) >= F.greatest(F.lit(2), F.floor(n / 2)), "template_steps")
            .otherwise("ok")
        )

    found = bind(F.transform(points, lambda p: tx.strip(F.lower(p["title"]))), reason)
    return bind(found, lambda r: F.struct((r == "ok").alias("ok"), r.alias("reason")))


def action_score(points: Column) -> Column:
    """Share of points that name an action."""
    good = F.filter(points, lambda p: any_hit(F.lower(F.concat_ws(" ", p["title"], p["content"])), lx.ACTION_MARKERS))
    return _ratio(F.size(good), F.size(points))


def is_template(a: Column, step_ok: Column, anchor: Column, level: Column, has_source: Column) -> Column:
    """Generic answer not drawn from its source; anchored answers are given more room."""
    n = hits(a, lx.TEMPLATE_MARKERS)
    low = (
        (a.contains("phân tích định tính") & a.contains("phân tích định lượng"))
        | (a.contains("qualitative analysis") & a.contains("quantitative analysis"))
        | (hits(a, lx.GENERIC_TEMPLATES) >= 3) | (n >= 4) | ((n >= 2) & (anchor < 0.34))
    )
    four = (n >= 5) | ((n >= 4) & (anchor < 0.22)) | ((n >= 3) & has_source & (anchor < 0.24))
    return F.when(level == 3, ~step_ok).when(level >= 5, any_hit(a, lx.ANSWER_META)).when(level == 4, four).otherwise(low)


# --- learning outcomes -----------------------------------------------------------------------


_CLO_LETTER = r"[\p{L}\p{N}_À-ỹ]"


def clo_terms(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({_CLO_LETTER}{{3,}})"), F.lit(1))
    return F.array_distinct(_without(words, lx.CLO_STOP_WORDS))


def clo_terms_held(terms: Column, text: Column) -> Column:
    """Those of an outcome's ``terms`` that are terms of a lowercased text, which is searched for each instead of being split."""
    def held(t: Column) -> Column:
        whole = F.concat(F.lit(rf"(?<!{_CLO_LETTER})\Q"), t, F.lit(rf"\E(?!{_CLO_LETTER})"))
        return text.contains(t) & F.regexp_like(text, whole)

    return F.when(text.isNotNull(), F.filter(terms, held))


def clo_overlap(text: Column, clo: Column) -> Column:
    """Share of an outcome's terms found in a text."""
    return bind(clo_terms(clo), lambda lo: set_share(lo, clo_terms(text)))


def clo_topics(text: Column, clo: Column) -> Column:
    """Topics an outcome asks for that the text mentions; both lowercased."""
    asks = {key: words for key, (words, _) in lx.CLO_TOPICS.items()}
    return F.array_intersect(tx.keys_hit(clo, asks), tx.keys_hit(text, asks))


def clo_penalty(title: Column, content_chars: Column, clo: Column) -> Column:
    """Penalty of a section that serves another kind of outcome; title and outcome lowercased."""
    concept = any_hit(clo, lx.CLO_CONCEPT)
    heading = title.rlike(r"^(chương|chapter)\s*[\divxlcdm]+") & (content_chars < 1500)
    build = concept & any_hit(title, lx.CLO_BUILD_TITLES)
    advanced = concept & any_hit(title, lx.CLO_ADVANCED_TITLES) & ~any_hit(title, lx.CLO_BASIC_TITLES)
    sales = (any_hit(clo, lx.CLO_RISK) & any_hit(title, lx.CLO_SALES_TITLES)
             & ~title.contains("rủi ro") & ~title.contains("an ninh"))
    parts = ((heading, 0.40), (build, 0.30), (advanced, 0.35), (sales, 0.20))
    return sum((F.when(cond, F.lit(v)).otherwise(F.lit(0.0)) for cond, v in parts), F.lit(0.0))


def section_features(title: Column, content: Column, lead_chars: int | None = None, asked: Column | None = None) -> Column:
    """What a match with outcomes needs of a section, whatever the outcome; of its terms only those in ``asked``, where given."""
    terms = clo_terms if asked is None else lambda text: clo_terms_held(asked, text)

    def read(x: Column) -> Column:
        lead, low = x["lead"], x["title"]
        return F.struct(low.alias("title"), terms(low).alias("title_terms"), terms(lead).alias("terms"),
                        tx.keys_hit(F.concat(low, F.lit("\n"), lead), _asked_topics()).alias("topics"), x["chars"].alias("chars"))

    return bind(F.struct(F.lower(tx.lead(content, lead_chars)).alias("lead"), F.lower(title).alias("title"),
                         F.length(tx.strip(content)).alias("chars")), read)


def outcome_features(clo: Column) -> Column:
    """What a match with sections needs of an outcome, whatever the section."""
    return bind(F.lower(clo), lambda low: F.struct(
        low.alias("clo"), clo_terms(low).alias("terms"), tx.keys_hit(low, _asked_topics()).alias("topics")))


def _asked_topics() -> dict:
    return {key: words for key, (words, _) in lx.CLO_TOPICS.items()}


def match_score(section: Column, outcome: Column) -> Column:
    """Match of a section with an outcome, 0 to 1, from the features of both."""

    def capped(score: Column, condition: Column, bonus: Column) -> Column:
        return bind(score, lambda r: F.when(condition, F.least(F.lit(1.0), r + bonus)).otherwise(r))

    lt, lo = section["title"], outcome["clo"]
    raw = set_share(outcome["terms"], section["title_terms"]) * 0.55 + set_share(outcome["terms"], section["terms"]) * 0.45
    raw = capped(raw, lo.contains("khái niệm") & lt.contains("khái niệm"), F.lit(0.12))
    raw = capped(raw, lo.contains("mô hình") & lt.contains("mô hình"), F.lit(0.10))
    raw = capped(raw, lo.contains("thuật ngữ") & any_hit(lt, lx.CLO_TERM_TITLES), F.lit(0.08))
    topics = F.size(F.array_intersect(outcome["topics"], section["topics"]))
    raw = capped(raw, topics > 0, topics * 0.06)
    return F.greatest(F.lit(0.0), raw - clo_penalty(lt, section["chars"], lo))


def clo_score(title: Column, content: Column, clo: Column, lead_chars: int | None = None) -> Column:
    """Match of a section, or of its first ``lead_chars`` characters, with an outcome, 0 to 1."""
    score = bind(outcome_features(clo), lambda o: bind(
        section_features(title, content, lead_chars, o["terms"]), lambda s: match_score(s, o)))
    return F.when(clo.isNull() | (clo == ""), F.lit(0.0)).otherwise(score)


def clo_aspects(clo: Column) -> Column:
    """Aspects an outcome asks for. A mere 'triển khai' is context and asks for nothing."""
    return F.coalesce(tx.keys_hit(F.lower(clo), {k: asks for k, (asks, _) in lx.CLO_ASPECTS.items()}),
                      F.array().cast("array<string>"))


def aspect_hits(text: Column) -> Column:
    """Aspects that a lowercased text shows."""
    return tx.keys_hit(text, {k: shows for k, (_, shows) in lx.CLO_ASPECTS.items()})


def aspect_gap(question: Column, answer: Column, clo: Column, title: Column, content: Column, level: Column,
               lead_chars: int | None = None, shown: Column | None = None) -> Column:
    """What an outcome asks for against what question and answer show.

    STRUCT(aspects, skills, topics, q_hit, a_hit, content_hit, content_missing, and coverages). ``shown`` gives the aspects of
    the content where they are known already.
    """
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    section = F.concat(low(title), F.lit("\n"), tx.lead(low(content), lead_chars)) if shown is None else low(title)
    base = F.struct(
        clo_aspects(clo).alias("aspects"), aspect_hits(low(question)).alias("q"), aspect_hits(low(answer)).alias("a"),
        aspect_hits(F.concat(low(question), F.lit("\n"), low(answer))).alias("qa"),
        (aspect_hits(section) if shown is None else F.array_union(aspect_hits(section), shown)).alias("s"))
    skills = tx.lit_array(lx.SKILL_ASPECTS)

    def narrowed(x: Column) -> Column:
        topics = F.array_except(x["aspects"], skills)
        served = F.array_union(x["qa"], x["s"])

        def pick(ts: Column) -> Column:
            relevant = F.filter(ts, lambda t: F.array_contains(served, t))
            named = lambda key, words: F.array_contains(ts, key) & any_hit(low(title), words)
            fallback = (
                F.when(named("khai_niem", lx.CONCEPT_FALLBACK_TITLES), F.array(F.lit("khai_niem")))
                .when(named("mo_hinh", ("mô hình",)), F.array(F.lit("mo_hinh")))
                .when(named("thuat_ngu", ("thuật ngữ",)), F.array(F.lit("thuat_ngu")))
                .otherwise(F.slice(ts, 1, 1)))
            return F.when((level > 2) | (F.size(ts) == 0), ts).when(F.size(relevant) > 0, relevant).otherwise(fallback)

        return bind(topics, pick)

    def gap(x: Column) -> Column:
        def parts(topics: Column) -> Column:
            q_hit, a_hit = F.array_intersect(x["aspects"], x["q"]), F.array_intersect(x["aspects"], x["a"])
            hit = F.array_intersect(topics, F.array_union(q_hit, a_hit))
            n = F.size(topics)
            whole = lambda part: F.when(n > 0, F.size(part) / n).otherwise(F.lit(1.0))
            return F.struct(
                x["aspects"].alias("aspects"), F.array_intersect(x["aspects"], skills).alias("skills"),
                topics.alias("topics"), q_hit.alias("q_hit"), a_hit.alias("a_hit"), hit.alias("content_hit"),
                F.array_except(topics, hit).alias("content_missing"),
                _ratio(F.size(q_hit), F.size(x["aspects"])).alias("q_coverage"), whole(hit).alias("content_coverage"),
                whole(F.array_intersect(topics, a_hit)).alias("a_content_coverage"))

        return bind(narrowed(x), parts)

    return bind(base, gap)


def aspect_verdict(gap: Column, level: Column) -> Column:
    """'ok', or which demand of the outcome is not met."""
    default = by_level(level, {3: F.lit("van_dung"), 4: F.lit("phan_tich"), 5: F.lit("danh_gia"), 6: F.lit("danh_gia")}, F.lit(""))

    def unmet(skill: Column) -> Column:
        met = (F.array_contains(gap["q_hit"], skill) | (skill == default)
               | (skill.isin("phan_tich", "so_sanh") & (level >= 4)) | ((skill == "danh_gia") & (level >= 5)))
        return ~met

    hit, n = F.size(gap["content_hit"]), F.size(gap["topics"])
    weak_answer = gap["a_content_coverage"] < 0.34
    q_topics = F.size(F.array_intersect(gap["q_hit"], gap["topics"]))
    return (
        F.when(F.size(gap["aspects"]) == 0, "ok")
        .when(F.exists(gap["skills"], unmet), "skill_missing")
        .when(n == 0, "ok")
        .when(level <= 2, F.when(hit < 1, "topic_missing").otherwise("ok"))
        .when(gap["content_coverage"] < 0.34, "topic_missing")
        .when(level <= 4, F.when(weak_answer & (hit < F.greatest(F.lit(1), F.floor(n / 2))), "answer_topic_missing").otherwise("ok"))
        .when(weak_answer, "answer_topic_missing")
        .when((q_topics == 0) & (gap["q_coverage"] < 0.34), "question_topic_missing")
        .otherwise("ok")
    )


# --- ceilings ------------------------------------------------------------------------------------


def effective_ceiling(ceiling: Column, level: Column, n_chars: Column) -> Column:
    boost = F.when(n_chars <= 300, (level >= 4).cast("int")).otherwise(
        by_level(level, {4: F.lit(1), 5: F.lit(2), 6: F.lit(2)}, F.lit(0)))
    return F.when(ceiling.isNull(), F.lit(6)).otherwise(F.least(F.lit(6), ceiling + boost))


def bloom_heuristic(text: Column) -> Column:
    """Level that a short passage shows, by keywords from level 6 down; 1 if none."""

    def level_of(low: Column) -> Column:
        out = F.when(low.isNull() | (F.length(tx.strip(low)) < 20), F.lit(1))
        for level, lex in lx.EXACT_KEYWORDS.items():
            out = out.when(any_hit(low, lex), F.lit(level))
        return out.otherwise(F.lit(1))

    return bind(F.lower(text), level_of)


def section_ceiling(content: Column) -> Column:
    """Highest level that a section can support."""

    def ceiling(x: Column) -> Column:
        n, low = x["n"], x["low"]
        out = F.when(n < 50, F.lit(1)).when(n <= 300, bloom_heuristic(low))
        for level, lex in lx.CEILING_KEYWORDS.items():
            value = F.when(n >= 400, F.lit(5)).otherwise(F.lit(4)) if level == 5 else F.lit(level)
            out = out.when(any_hit(low, lex), value)
        return out.when(n >= 800, F.lit(5)).when(n >= 400, F.lit(4)).otherwise(F.lit(3))

    return bind(F.struct(F.length(tx.strip(content)).alias("n"), F.lower(content).alias("low")), ceiling)
