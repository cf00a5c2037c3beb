"""Targets, candidate order, assignment and assembly of a question bank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from coursebank import lexicons as lx
from coursebank.functions import scoring as sc
from coursebank.functions import text as tx
from coursebank.functions.labels import points
from coursebank.operators.structure import computed_once

c = F.col
MAX_BOILERPLATE, MAX_SKIPS = 0.72, 20


def expand_plan(plan: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One target per question: plan rows (keys, level, count, points, clo) times their count.

    ``k`` numbers the targets of one level within a document. Where a plan has several rows of one level, ``item`` gives
    their order and stays in the result; else the number is the position in the row's own sequence, without a shuffle.
    """
    n = F.when(c("count") > 0, F.sequence(F.lit(1), c("count"))).otherwise(F.array().cast("array<int>"))
    rows, extra = plan, []
    if "item" in plan.columns:
        earlier = W.partitionBy(*keys, "level").orderBy("item").rowsBetween(W.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.greatest(F.coalesce("count", F.lit(0)), F.lit(0))).over(earlier), F.lit(0)).cast("int")
        rows, extra = plan.withColumn("before", before), ["item"]
    rows = rows.withColumn("k", F.explode(n))
    if extra:
        rows = rows.withColumn("k", c("k") + c("before"))
    default = sc.by_level(c("level"), {k: F.lit(v) for k, v in lx.DEFAULT_POINTS.items()}, F.lit(1.0))
    total = F.coalesce(F.nullif(c("points"), F.lit(0.0)), default)
    need = F.floor(total / lx.POINT_VALUE).cast("int")
    cap = sc.by_level(c("level"), {k: F.lit(v) for k, v in lx.POINT_CAPS.items()}, need)
    return rows.select(*keys, *extra, "level", "k", total.alias("points"), F.least(need, cap).alias("required_points"), "clo")


def rank_candidates(sections: DataFrame, min_clo: float = 0.06) -> DataFrame:
    """Rank of each section for each level of its document.

    Input: doc_id, pos, level, ceiling, boilerplate, and clo_match (NULL where the plan has no outcome).
    Without an outcome: exact ceiling, then unknown, then others; from level 3 by boilerplate. With one:
    outcome score of at least ``min_clo`` down, level distance, boilerplate; if no section reaches it,
    the first order holds for all.
    """
    group = F.when(c("ceiling") == c("level"), 0).when(c("ceiling").isNull(), 1).otherwise(2)
    plates = F.when(c("level") >= 3, c("boilerplate")).otherwise(F.lit(0.0))
    distance = F.abs(F.coalesce("ceiling", "level") - c("level"))
    fits = F.coalesce(c("clo_match") >= min_clo, F.lit(False))
    # One flag per (document, level); a max over the window would hold the same rows the rank sorts anyway.
    part = W.partitionBy("doc_id", "level")
    rows = sections.withColumn("by_clo", F.max(fits).over(part)).where(~c("by_clo") | fits)
    order = [F.when(c("by_clo"), -c("clo_match")), F.when(c("by_clo"), distance),
             F.when(c("by_clo"), c("boilerplate")), group, plates, c("pos")]
    return rows.withColumn("rank", F.row_number().over(part.orderBy(*order)))


def first_pass(attempts: DataFrame, key: list[str], max_attempts: int = 5) -> DataFrame:
    """First passing attempt of each key, among the first ``max_attempts``."""
    good = attempts.where(c("passed") & (c("attempt") <= max_attempts))
    return good.groupBy(*key).agg(F.min("attempt").alias("attempt"))


def with_verdicts(ranked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates with the attempt of their first accepted reply (NULL if none)."""
    return ranked.join(verdicts.select("doc_id", "pos", "level", "attempt"), ["doc_id", "pos", "level"], "left")


def assign(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """The section of each target.

    ``ranked``: doc_id, pos, level, rank, n_chars, boilerplate, feasible, by_clo, and attempt (the first
    accepted reply, NULL if none). All targets of one level share order and verdicts, so the
    k-th target takes the k-th passing section, as long as fewer sections than the cap failed before it.
    The walk over a level's candidates is a fold over narrow rows (no texts) of one document.
    """
    enough = c("n_chars") >= F.when(c("level") >= 2, 150).otherwise(80)
    heavy = c("level").isin(3, 4) & (c("boilerplate") > MAX_BOILERPLATE)
    entry = F.when(enough, F.struct("rank", "pos", heavy.alias("heavy"), "feasible",
                                    c("attempt").isNotNull().alias("passed"), "attempt"))
    per_level = ranked.groupBy("doc_id", "level").agg(
        F.array_sort(F.collect_list(entry)).alias("cands"), F.first("by_clo").alias("by_clo"))
    cap = sc.by_level(c("level"), {k: F.lit(v) for k, v in lx.SECTIONS_TRIED.items()})
    cap = F.when(c("by_clo"), F.least(cap, F.lit(lx.SECTIONS_TRIED_WITH_CLO))).otherwise(cap)
    kept = "array<struct<pos:int,attempt:int>>"
    zero = F.struct(F.lit(0).alias("skipped"), F.lit(0).alias("tried"), F.array().cast(kept).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        skip = x["heavy"] & (acc["skipped"] < MAX_SKIPS) & (acc["tried"] < c("cap") - 2)
        tested = ~skip & x["feasible"] & (acc["tried"] < c("cap"))
        taken = F.struct(x["pos"].cast("int").alias("pos"), x["attempt"].cast("int").alias("attempt"))
        return F.struct(
            (acc["skipped"] + skip.cast("int")).alias("skipped"),
            (acc["tried"] + (tested & ~x["passed"]).cast("int")).alias("tried"),
            F.when(tested & x["passed"], F.array_append(acc["out"], taken)).otherwise(acc["out"]).alias("out"))

    folded = per_level.withColumn("cap", cap).select("doc_id", "level", F.aggregate("cands", zero, step)["out"].alias("out"))
    # The array's own order is the target number, so targets look their section up instead of joining rows.
    found = targets.join(folded, ["doc_id", "level"], "left").withColumn("hit", F.get("out", c("k") - 1))
    return found.select(*targets.columns, c("hit.pos").alias("pos"), c("hit.attempt").alias("attempt"))


def assign_plan(candidates: DataFrame, targets: DataFrame, min_clo: float = 0.06, max_boilerplate: float = MAX_BOILERPLATE,
                max_skips: int = MAX_SKIPS, caps: dict[int, int] | None = None, cap_with_clo: int = lx.SECTIONS_TRIED_WITH_CLO,
                min_chars: tuple[int, int] = (80, 150)) -> DataFrame:
    """The section of each target, where a level may have several plan rows with different outcomes.

    ``candidates``: doc_id, level, clo, pos, ceiling, boilerplate, n_chars, feasible, clo_match, attempt (NULL without an
    accepted reply), for every outcome of the plan ('' or NULL for none). ``targets``: doc_id, level, k, clo.

    The targets of a level share its sections: a section is used once a level. Each target in turn takes the order that
    is left: with an outcome the unused sections that reach ``min_clo`` by score, level distance and boilerplate, and once
    these are used up, as without an outcome, exact ceilings, unknown ones, then others. It walks that order past short
    sections and, at levels 3 and 4, past at most ``max_skips`` heavy ones, and takes the first section with an accepted
    reply among those it may try. ``why`` tells what left a target empty: ``no_sections``, ``used_up`` (every section
    already has a question of this level), ``cap`` (as many sections tried as allowed) or ``none_passed``.

    A level of a document is one fold over narrow rows, without texts; documents and levels don't depend on each other.
    """
    blank = F.coalesce(F.trim("clo"), F.lit(""))
    caps = lx.SECTIONS_TRIED if caps is None else caps
    group = F.when(c("ceiling") == c("level"), 0).when(c("ceiling").isNull(), 1).otherwise(2)
    plates = F.when(c("level") >= 3, c("boilerplate")).otherwise(F.lit(0.0))
    fits = (c("clo_key") != "") & F.coalesce(c("clo_match") >= min_clo, F.lit(False))
    walked = F.struct(
        c("pos").cast("int").alias("pos"), c("attempt").cast("int").alias("attempt"), F.coalesce("feasible", F.lit(False)).alias("ok"),
        (c("level").isin(3, 4) & (c("boilerplate") > max_boilerplate)).alias("heavy"),
        (c("n_chars") >= F.when(c("level") >= 2, min_chars[1]).otherwise(min_chars[0])).alias("enough"))
    rows = candidates.withColumn("clo_key", blank)
    per_clo = rows.groupBy("doc_id", "level", "clo_key").agg(
        F.array_sort(F.collect_list(F.struct(group.alias("a"), plates.alias("b"), "pos", walked.alias("x")))).alias("plain"),
        F.array_sort(F.collect_list(F.when(fits, F.struct(
            (-c("clo_match")).alias("a"), F.abs(F.coalesce("ceiling", "level") - c("level")).alias("b"),
            c("boilerplate").alias("p"), "pos", walked.alias("x"))))).alias("by_clo"))
    orders = F.struct("clo_key", F.transform("plain", lambda e: e["x"]).alias("plain"), F.transform("by_clo", lambda e: e["x"]).alias("by_clo"))
    per_level = per_clo.groupBy("doc_id", "level").agg(F.collect_list(orders).alias("orders"))
    asked = targets.withColumn("clo_key", blank).groupBy("doc_id", "level").agg(
        F.array_sort(F.collect_list(F.struct("k", "clo_key"))).alias("targets"))
    cap = sc.by_level(c("level"), {k: F.lit(v) for k, v in caps.items()})
    no_order = F.array().cast("array<struct<pos:int,attempt:int,ok:boolean,heavy:boolean,enough:boolean>>")

    def walk(order: Column, most: Column) -> Column:
        hit = F.lit(None).cast("struct<pos:int,attempt:int>")
        zero = F.struct(F.lit(0).alias("skipped"), F.lit(0).alias("tried"), F.lit(False).alias("capped"), hit.alias("hit"))

        def step(acc: Column, x: Column) -> Column:
            here = x["enough"] & acc["hit"].isNull()
            skip = here & x["heavy"] & (acc["skipped"] < max_skips) & (acc["tried"] < most - 2)
            meant = here & ~skip & x["ok"]
            tested = meant & (acc["tried"] < most)
            taken = F.struct(x["pos"].alias("pos"), x["attempt"].alias("attempt"))
            return F.struct(
                (acc["skipped"] + skip.cast("int")).alias("skipped"), (acc["tried"] + tested.cast("int")).alias("tried"),
                (acc["capped"] | (meant & (acc["tried"] >= most))).alias("capped"),
                F.when(tested & x["attempt"].isNotNull(), taken).otherwise(acc["hit"]).alias("hit"))

        return F.aggregate(order, zero, step)

    def fill(acc: Column, t: Column) -> Column:
        def unused(order: Column) -> Column:
            return F.filter(order, lambda x: ~F.array_contains(acc["used"], x["pos"]))

        mine = F.get(F.filter("orders", lambda o: o["clo_key"] == t["clo_key"]), F.lit(0))
        most = F.when(t["clo_key"] != "", F.least(c("cap"), F.lit(cap_with_clo))).otherwise(c("cap"))

        def found(by_clo: Column) -> Column:
            order = F.when(F.size(by_clo) > 0, by_clo).otherwise(unused(F.coalesce(mine["plain"], no_order)))
            return tx.bind(order, lambda o: tx.bind(walk(o, most), lambda w: F.struct(
                t["k"].alias("k"), w["hit"].alias("hit"),
                F.when(w["hit"].isNotNull(), F.lit(None).cast("string")).when(F.coalesce(F.size(mine["plain"]), F.lit(0)) <= 0, "no_sections")
                .when(F.size(o) == 0, "used_up").when(w["capped"], "cap").otherwise("none_passed").alias("why"))))

        return tx.bind(tx.bind(unused(F.coalesce(mine["by_clo"], no_order)), found), lambda r: F.struct(
            F.when(r["hit"].isNotNull(), F.array_append(acc["used"], r["hit"]["pos"])).otherwise(acc["used"]).alias("used"),
            F.array_append(acc["out"], r).alias("out")))

    start = F.struct(F.array().cast("array<int>").alias("used"),
                     F.array().cast("array<struct<k:int,hit:struct<pos:int,attempt:int>,why:string>>").alias("out"))
    folded = asked.join(per_level, ["doc_id", "level"], "left").withColumn("cap", cap)
    out = folded.select("doc_id", "level", F.explode(F.aggregate("targets", start, fill)["out"]).alias("r"))
    out = out.select("doc_id", "level", "r.k", "r.hit.pos", "r.hit.attempt", "r.why")
    return targets.join(out, ["doc_id", "level", "k"], "left").select(*targets.columns, "pos", "attempt", "why")


def assemble_results(assigned: DataFrame, sections: DataFrame, lang: str = "vi") -> DataFrame:
    """Result rows of the filled targets: points, provenance label and section. A section is labelled once for all its targets."""
    asked = assigned.where(c("pos").isNotNull()).groupBy("doc_id", "pos").agg(
        F.collect_list(F.struct("level", "k", "attempt", "points", "clo")).alias("asked"))
    used = asked.join(sections, ["doc_id", "pos"]).withColumn("num", tx.section_number(c("title")))
    info = tx.section_label(F.coalesce("chapter", F.lit("Nội dung")), c("num"), tx.display_title(c("title")), c("page_num"), lang)
    rows = computed_once(used, ["doc_id", "pos", "asked"], {"section_info": info})
    rows = rows.select("doc_id", "pos", "section_info", F.explode("asked").alias("t")).select("doc_id", "pos", "section_info", "t.*")
    label = F.concat(F.lit("Bloom "), c("level").cast("string"))
    return rows.withColumn("p", points(label, c("points"))).select(
        "doc_id", "level", "k", "pos", "attempt", "p.total_points", "p.sub_points_count", "p.points_breakdown", "section_info", "clo")


def pseudo_chapter(sections: DataFrame) -> DataFrame:
    """Chapter by title number, else by the section's own chapter, else by relative position."""
    n, at = F.count("*").over(W.partitionBy("doc_id")), c("pos")
    share = at / n
    long_doc = F.when(share < 0.25, 1).when(share < 0.5, 2).when(share < 0.75, 3).otherwise(4)
    middle = F.when(share < 0.4, 1).when(share < 0.75, 2).otherwise(3)
    number = F.when(n >= 15, long_doc).when(n >= 6, middle).otherwise(at + 1)
    titled = tx.first_group(c("title"), r"^(\d+)\.")
    own = F.when(c("chapter") != "Unknown", c("chapter"))
    return sections.withColumn("slot_chapter", F.coalesce(
        F.concat(F.lit("Chương "), titled), F.nullif(own, F.lit("")), F.concat(F.lit("Chương "), number.cast("string"))))


def round_robin(sections: DataFrame, n_slots: int, seed: int = 0) -> DataFrame:
    """Slots over the chapters in string order, cycling through each chapter's sections.

    ``sections`` has doc_id, pos and slot_chapter. The level of a slot is a seeded hash.
    """
    in_chapter = W.partitionBy("doc_id", "slot_chapter").orderBy("pos")
    placed = sections.select("doc_id", "slot_chapter", "pos", (F.row_number().over(in_chapter) - 1).alias("idx"))
    sizes = sections.groupBy("doc_id", "slot_chapter").agg(F.count("*").cast("int").alias("n_sections"))
    chapters = sizes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slot_chapter", "n_sections"))).alias("ch"))
    slots = chapters.select("doc_id", "ch", F.explode(F.sequence(F.lit(0), F.lit(n_slots - 1))).alias("slot"))
    n = F.size("ch")
    mine = F.get("ch", c("slot") % n)
    picked = slots.select("doc_id", "slot", mine["slot_chapter"].alias("slot_chapter"),
                          (F.floor(c("slot") / n) % mine["n_sections"]).cast("int").alias("idx"))
    # The first 60 bits of a digest, as a number.
    name = F.md5(F.concat_ws("/", F.lit(str(seed)), c("doc_id").cast("string"), c("slot").cast("string")))
    level = (F.conv(F.substring(name, 1, 15), 16, 10).cast("bigint") % 6 + 1).cast("int")
    return picked.join(placed, ["doc_id", "slot_chapter", "idx"]).select("doc_id", "slot", "slot_chapter", "pos", level.alias("level"))
