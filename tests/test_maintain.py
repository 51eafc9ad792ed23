"""Reach and chains kept up to date against computing them anew, over random sequences of changes."""

import random

import pytest

from rampart.operators import maintain, rules
from rampart.operators.expand import reach
from rampart.plans.projection import Graph

HOPS = 4


def pairs(df):
    return {(r.start, r.node): r.depth for r in df.collect()}


def edges_of(spark, own):
    return spark.createDataFrame(sorted(own), "src long, dst long")


def starts_of(spark, own):
    return spark.createDataFrame(sorted(own), "start long, node long")


def test_reach_follows_random_changes(spark):
    rng = random.Random(3)
    nodes, edges, starts = range(30), set(), {(s, rng.randrange(30)) for s in range(6)}
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    reached = reach(starts_of(spark, starts), edges_of(spark, edges), HOPS)
    for step in range(5):
        before, began = set(edges), set(starts)
        edges -= set(rng.sample(sorted(edges), min(len(edges), (1, 5, 0, 12, 40)[step])))
        edges |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range((2, 0, 5, 10, 30)[step])}
        if step in (2, 4):
            starts -= {min(starts)}
            starts |= {(9 + step, rng.choice(nodes))}
        change = maintain.maintain(
            reached, edges_of(spark, edges), edges_of(spark, edges - before), edges_of(spark, before - edges), starts_of(spark, starts - began), starts_of(spark, began - starts), HOPS
        )
        old, reached = pairs(reached), change.of(reached)
        want = pairs(reach(starts_of(spark, starts), edges_of(spark, edges), HOPS))
        assert pairs(reached) == want
        assert pairs(change.now) == {k: d for k, d in want.items() if old.get(k) != d}
        assert {(r.start, r.node) for r in change.gone.collect()} == set(old) - set(want)


def test_a_change_far_away_touches_nothing(spark):
    edges, starts = {(i, i + 1) for i in range(20)} | {(100, 101)}, {(0, 0)}
    reached = reach(starts_of(spark, starts), edges_of(spark, edges), HOPS)
    none = starts_of(spark, set())
    change = maintain.maintain(reached, edges_of(spark, edges - {(100, 101)} | {(101, 102)}), edges_of(spark, {(101, 102)}), edges_of(spark, {(100, 101)}), none, none, HOPS)
    assert change.now.isEmpty() and change.gone.isEmpty()


def graph(spark, rng, world):
    fns = range(25)
    df = spark.createDataFrame
    return Graph(
        functions=df([(f, f in world["taint"], f in world["source"]) for f in fns], "fn long, tainted boolean, source boolean"),
        calls=df(sorted(world["calls"]), "src long, dst long"),
        endpoints=df([(e, f"/p{e}", e % 4 != 0, e % 4) for e in range(8)], "ep long, path string, is_public boolean, zone_level int"),
        handled_by=df(sorted(world["handled"]), "ep long, fn long"),
        stores=df([(d, f"s{d}", d != 2) for d in range(4)], "ds long, name string, contains_pii boolean"),
        access=df(sorted(world["access"]), "fn long, ds long, access string"),
        findings=df([(f, "sast", "HIGH", "open", ("CWE-89", "CWE-306", "CWE-1")[f % 3], "r", "t", "d") for f in sorted({f for f, _ in world["affects"]})], "f long, type string, raw_severity string, status string, cwe_id string, rule_id string, title string, description string"),
        affects=df(sorted(world["affects"]), "f long, fn long"),
        uses=df([], "fn long, dep string"),
        affects_dep=df([], "f long, dep string"),
    )


def test_chains_follow_random_changes(spark):
    rng = random.Random(8)
    pick = lambda n: rng.randrange(n)
    world = {
        "calls": {(pick(25), pick(25)) for _ in range(45)}, "handled": {(e, pick(25)) for e in range(8)}, "access": {(pick(25), pick(4), "read") for _ in range(16)},
        "affects": {(f, pick(25)) for f in range(40)}, "taint": {pick(25) for _ in range(8)}, "source": {pick(25) for _ in range(12)},
    }
    key = lambda df: sorted(map(tuple, df.select("rule", "f", "ds", "ep_path", "has_taint", "confidence").collect()))
    g = graph(spark, rng, world)
    starts = lambda w: {(e, f) for e, f in w["handled"]}
    reached = reach(starts_of(spark, starts(world)), g.calls, rules.MOST_HOPS)
    support = maintain.chain_support(g, reached)
    assert key(maintain.chains_of(support)) == key(rules.all_chains(g)) != []
    for step in (1, 2):
        old = {k: set(v) for k, v in world.items()}
        world["calls"] = world["calls"] - set(rng.sample(sorted(world["calls"]), 3)) | {(pick(25), pick(25)) for _ in range(3)}
        if step == 1:
            world["handled"] = {(e, pick(25) if e == 3 else f) for e, f in world["handled"]}
            world["access"] = world["access"] - {min(world["access"])} | {(pick(25), 1, "read")}
        if step == 2:
            world["affects"] = world["affects"] - {min(world["affects"])} | {(50, pick(25))}
            world["taint"] = world["taint"] ^ {pick(25)}
        g = graph(spark, rng, world)
        change = maintain.maintain(
            reached, g.calls, edges_of(spark, world["calls"] - old["calls"]), edges_of(spark, old["calls"] - world["calls"]), starts_of(spark, starts(world) - starts(old)), starts_of(spark, starts(old) - starts(world)), rules.MOST_HOPS
        )
        before, reached = reached, change.of(reached)
        fns = {x[0] for k in ("access",) for x in old[k] ^ world[k]} | {x[1] for x in old["affects"] ^ world["affects"]} | (old["taint"] ^ world["taint"])
        fns |= {x for e in old["calls"] ^ world["calls"] for x in e}
        fns = spark.createDataFrame([(f,) for f in sorted(fns)], "fn long")
        ends = maintain.ends_of(reached, fns).union(maintain.ends_of(before, fns)).union(change.now.select("start")).union(change.gone.select("start")).distinct()
        previous = key(maintain.chains_of(support))
        support, moved = maintain.maintain_chains(support, g, reached, ends)
        now = key(maintain.chains_of(support))
        assert now == key(rules.all_chains(g))
        assert {r[:3] for r in set(now) ^ set(previous)} <= {tuple(r) for r in moved.collect()}


@pytest.mark.parametrize("name", ["a"])
def test_difference(spark, name):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], f"{name} int"), spark.createDataFrame([(2,), (3,)], f"{name} int")
    added, removed = maintain.difference(a, b)
    assert [r[0] for r in added.collect()] == [3] and [r[0] for r in removed.collect()] == [1]
