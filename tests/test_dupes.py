"""Greedy groups of near copies against the sequential rule."""

import random

import pytest

from loomset.operators import dupes


def sequential(nodes, threshold):
    order = sorted((n for n in nodes if n[2]), key=lambda n: n[1])
    gone, groups = set(), []
    for ident, pri, own in order:
        if ident in gone:
            continue
        members = [m for m, p, h in order if m not in gone and (m == ident or (p > pri and bin(h ^ own).count("1") <= threshold))]
        gone.update(members)
        groups += [members] if len(members) > 1 else []
    return {n[0]: 0 for n in nodes} | {m: k for k, g in enumerate(groups, 1) for m in g}


@pytest.mark.parametrize("tail", [1_000_000, 50, 0])
def test_greedy_groups(spark, monkeypatch, tail):
    monkeypatch.setattr(dupes, "TAIL_EDGES", tail)
    rng = random.Random(3)
    base, nodes = [rng.getrandbits(62) for _ in range(20)], []
    for i in range(300):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            h ^= 1 << rng.randrange(63)
        nodes.append((i, (i * 7919) % 1000 * 1000 + i, h if i % 17 else 0))
    got = dupes.greedy_groups(spark.createDataFrame(nodes, "id long, pri long, phash long"), 6)
    assert {r["id"]: r["duplicate_group"] for r in got.collect()} == sequential(nodes, 6)


def test_greedy_groups_of_nothing(spark):
    assert dupes.greedy_groups(spark.createDataFrame([], "id long, pri long, phash long"), 6).collect() == []
    alone = spark.createDataFrame([(1, 1, 5), (2, 2, 0)], "id long, pri long, phash long")
    assert sorted(map(tuple, dupes.greedy_groups(alone, 1).collect())) == [(1, 0), (2, 0)]
