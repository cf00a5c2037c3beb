"""Assignment of sections where a level has several plan rows, against a step-by-step walk."""

import random

import pytest

from coursebank import lexicons as lx
from coursebank.operators import planning as pl

CANDIDATE = ("doc_id bigint, level int, clo string, pos int, ceiling int, boilerplate double, n_chars int, feasible boolean, "
             "clo_match double, attempt int")


def walk_plan(cands, targets, caps, with_clo=8):
    """One target after another, as a person would do it; also counts targets for which a used section would be taken again."""
    out, used, reused = {}, set(), 0
    for doc, level, k, clo in sorted(targets, key=lambda t: t[:3]):
        mine = [x for x in cands if x[0] == doc and x[1] == level and (x[2] or "").strip() == clo]
        free = [x for x in mine if (doc, level, x[3]) not in used]
        plates = lambda x: x[5] if level >= 3 else 0.0
        plain = sorted(free, key=lambda x: (0 if x[4] == level else 1 if x[4] is None else 2, plates(x), x[3]))
        fit = [x for x in free if clo and x[8] is not None and x[8] >= 0.06]
        fit.sort(key=lambda x: (-x[8], abs((x[4] if x[4] is not None else level) - level), x[5], x[3]))
        order = fit or plain
        if not order:
            # The fallback for an empty order picks among the sections that are still free: there are none.
            reused += len(free)
        cap = min(with_clo, caps[level]) if clo else caps[level]
        skipped = tried = 0
        hit, capped = None, False
        for x in order:
            if x[6] < (150 if level >= 2 else 80):
                continue
            if level in (3, 4) and x[5] > 0.72 and skipped < 20 and tried < cap - 2:
                skipped += 1
                continue
            if not x[7]:
                continue
            if tried >= cap:
                capped = True
                break
            tried += 1
            if x[9] is not None:
                hit = x
                used.add((doc, level, x[3]))
                break
        why = None if hit else "no_sections" if not mine else "used_up" if not order else "cap" if capped else "none_passed"
        out[doc, level, k] = (hit and hit[3], hit and hit[9], why)
    return out, reused


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(spark, seed):
    rng = random.Random(seed)
    cands, plan = [], []
    for doc in range(24):
        clos = ["", "outcome a", "outcome b"]
        for pos in range([0, 1, 3, 9, 12, 40][doc % 6]):
            for level in range(1, 7):
                for clo in clos:
                    cands.append((doc, level, clo, pos, rng.choice([None, 1, 2, 3, 4, 5, 6]), rng.choice([0.0, 0.4, 0.8, 1.0]),
                                  rng.choice([60, 100, 400, 400]), rng.random() < 0.8, rng.choice([None, 0.0, 0.05, 0.06, 0.3, 0.3]),
                                  rng.choice([None, 1, 3] if pos < 9 else [None, None, 1])))
        for level in range(1, 7):
            for item in range(3):
                plan.append((doc, level, item, rng.choice([None, 0, 1, 4, 9]), None, rng.choice([None, " ", *clos])))
    plan = spark.createDataFrame(plan, "doc_id bigint, level int, item int, count int, points double, clo string")
    targets = pl.expand_plan(plan)
    asked = [(r.doc_id, r.level, r.k, (r.clo or "").strip()) for r in targets.collect()]
    assert len({x[:3] for x in asked}) == len(asked)
    caps = {**lx.SECTIONS_TRIED, 3: 5, 4: 4}
    got = pl.assign_plan(spark.createDataFrame(cands, CANDIDATE), targets, caps=caps).collect()
    want, reused = walk_plan(cands, asked, caps)
    assert {(r.doc_id, r.level, r.k): (r.pos, r.attempt, r.why) for r in got} == want
    assert {w[2] for w in want.values()} == {None, "no_sections", "used_up", "cap", "none_passed"}
    # So a section never carries two questions of one level.
    assert reused == 0


def test_next_outcome_sections_then_the_common_order(spark):
    """An outcome's two fitting sections go first; once they are used, its targets take the order without outcomes."""
    cands = [(1, 2, "x", pos, ceiling, 0.0, 500, True, match, 1)
             for pos, ceiling, match in [(0, 2, 0.0), (1, 5, 0.5), (2, 6, 0.1), (3, 2, 0.01)]]
    plan = spark.createDataFrame([(1, 2, 0, 5, None, "x")], "doc_id bigint, level int, item int, count int, points double, clo string")
    rows = pl.assign_plan(spark.createDataFrame(cands, CANDIDATE), pl.expand_plan(plan)).orderBy("k").collect()
    assert [r.pos for r in rows] == [1, 2, 0, 3, None]
    assert rows[-1].why == "used_up"


def test_nothing_to_assign(spark):
    plan = spark.createDataFrame([(1, 2, 0, 2, None, None), (2, 2, 0, 0, None, None)],
                                 "doc_id bigint, level int, item int, count int, points double, clo string")
    none = spark.createDataFrame([], CANDIDATE)
    assert [r.why for r in pl.assign_plan(none, pl.expand_plan(plan)).collect()] == ["no_sections"] * 2
    assert pl.assign_plan(none, pl.expand_plan(plan.where("false"))).count() == 0
