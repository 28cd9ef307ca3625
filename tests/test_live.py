"""The recommendation that edits keep up to date: the same rows as a rerun, in whatever order the edits come."""

import random

import pytest

from loomset.operators import live, quota
from loomset.schema import SCALES, YAWS

KIND = live.EDITS


def sample(rng, ord_, seq):
    """An analysis edit of one sample; every fifth is in one of some groups, which stay as they are."""
    group = 1 + ord_ % 7 if ord_ % 5 == 0 else 0
    scale, yaw = rng.choice([*SCALES, "other"]), rng.choice([*YAWS, "none"])
    quality = rng.choice([0.2, 0.5, 0.5, 0.9, rng.random()])
    return (ord_, "analysis", seq, None, scale, yaw, group, rng.choice(["PASS", "REVIEW", "REJECT"]), quality, float(rng.randrange(4)), float(rng.randrange(3)), rng.random() < 0.8, rng.random() < 0.1)


def human(rng, ord_, seq):
    return (ord_, "human", seq, rng.choice([None, "推荐", "备选", "淘汰"]), *[None] * 9)


def held(edits):
    """What the edits come to, one by one."""
    rows = {}
    for e in sorted(edits, key=lambda e: e[2]):
        row = rows.setdefault(e[0], {})
        row["human" if e[1] == "human" else "analysis"] = e
    return rows


def rerun(spark, edits, target):
    """quota.choose over the pool of the final rows."""
    final = [(o, *r["analysis"][4:]) for o, r in held(edits).items() if "analysis" in r]
    rows = spark.createDataFrame(final, f"ord long, {live.ANALYSIS}").where("qualified and not gone")
    from loomset.operators.dupes import best_per_group

    return {r["ord"] for r in quota.choose(best_per_group(rows), target).collect()}


@pytest.mark.parametrize("target,seed", [(12, 1), (40, 2)])
def test_any_order_of_edits_gives_what_a_rerun_gives(spark, tmp_path, monkeypatch, target, seed):
    monkeypatch.setattr(live, "MOST", 2)  # short heads, which have to be filled up
    rng = random.Random(seed)
    edits = [sample(rng, o, o) for o in range(220)]
    edits += [sample(rng, rng.randrange(260), 1000 + k) for k in range(160)] + [human(rng, rng.randrange(230), 2000 + k) for k in range(40)]
    rng.shuffle(edits)
    own = live.LiveRecommendation(spark, f"file://{tmp_path}/live", target, 4)
    sizes, done = [200, 60, 1], []
    rebuilt = []
    real = own.rebuild
    monkeypatch.setattr(own, "rebuild", lambda: (rebuilt.append(1), real()))
    epoch = 0
    while len(done) < len(edits):
        part = edits[len(done) : len(done) + (sizes[epoch] if epoch < len(sizes) else 160)]
        own.apply(spark.createDataFrame(part, KIND), epoch)
        if epoch == 1:
            own.apply(spark.createDataFrame(part, KIND), epoch)  # delivered again
        done += part
        epoch += 1
        assert {r["ord"] for r in own.chosen().collect()} == rerun(spark, done, target), (epoch, target)
    assert len(rebuilt) == 1  # the first time, before there was any state
    rows = held(edits)
    chosen = rerun(spark, edits, target)
    got = {r["ord"]: (r["auto_status"], r["status"]) for r in own.statuses().collect()}
    want = {}
    for o, r in rows.items():
        if "analysis" in r and not r["analysis"][12]:
            auto = "推荐" if o in chosen else "淘汰" if r["analysis"][7] == "REJECT" else "备选"
            want[o] = (auto, (r["human"][3] if "human" in r else None) or auto)
    assert got == want


def test_a_writer_that_died_between_the_switches(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    first, then = [sample(rng, o, o) for o in range(60)], [sample(rng, o, 100 + o) for o in range(0, 60, 3)]
    own = live.LiveRecommendation(spark, f"file://{tmp_path}/live", 10, 4)
    own.apply(spark.createDataFrame(first, KIND), 0)
    with monkeypatch.context() as m:
        m.setattr(own, "_keep", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            own.apply(spark.createDataFrame(then, KIND), 1)
    again = live.LiveRecommendation(spark, f"file://{tmp_path}/live", 10)
    assert {r["ord"] for r in again.chosen().collect()} == rerun(spark, first + then, 10)
    again.apply(spark.createDataFrame(then, KIND), 1)
    assert {r["ord"] for r in again.chosen().collect()} == rerun(spark, first + then, 10)
    more = live.LiveRecommendation(spark, f"file://{tmp_path}/live", 25)  # another target
    assert {r["ord"] for r in more.chosen().collect()} == rerun(spark, first + then, 25)


def test_nothing(spark, tmp_path):
    own = live.LiveRecommendation(spark, f"file://{tmp_path}/live", 10, 4)
    assert own.chosen().collect() == [] and own.statuses().collect() == []
    own.apply(spark.createDataFrame([], KIND))
    assert own.chosen().collect() == []


def test_ranks_with_nulls_are_those_of_the_columns(spark):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, 0.0, 1.0, 2.0])
    rows = spark.createDataFrame([(o, pick(), pick(), pick()) for o in range(80)], "ord long, face_quality double, brisque double, blur double")
    from loomset.functions.expressions import rank_key, rank_order

    assert [r["ord"] for r in rows.orderBy(rank_key()).collect()] == [r["ord"] for r in rows.orderBy(*rank_order()).collect()]
