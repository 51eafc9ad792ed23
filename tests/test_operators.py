"""Operators on small hand-made graphs and rows."""

import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from rampart.functions import columns as C
from rampart.operators import expand, history, match, severity
from rampart.streaming import events


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def starts(spark, *nodes):
    return spark.createDataFrame([("s", n) for n in nodes], "start string, node string")


def reached(df):
    return {r.node: r.depth for r in df.collect()}


def test_reach_bounds_hops(spark):
    line = edges(spark, *((f"n{i}", f"n{i + 1}") for i in range(7)))
    assert reached(expand.reach(starts(spark, "n0"), line, 5)) == {f"n{i}": i for i in range(6)}
    assert reached(expand.reach(starts(spark, "n0"), line, 6))["n6"] == 6


def test_reach_ends_in_cycles_and_keeps_least_depth(spark):
    ring = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"))
    assert reached(expand.reach(starts(spark, "a"), ring, 6)) == {"a": 0, "b": 1, "c": 1}


def test_reach_ignores_repeated_edges_and_islands(spark):
    one = edges(spark, ("a", "b"))
    more = edges(spark, ("a", "b"), ("a", "b"), ("x", "y"))
    assert reached(expand.reach(starts(spark, "a"), one, 3)) == reached(expand.reach(starts(spark, "a"), more, 3))


def test_trails_of_a_diamond(spark):
    diamond = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    paths = [r.path for r in expand.trails(starts(spark, "a"), diamond, 4).where("node = 'd'").collect()]
    assert sorted(paths) == [["a", "b", "d"], ["a", "c", "d"]]


def test_trails_use_no_edge_twice_but_may_meet_nodes_again(spark):
    ring = edges(spark, ("a", "b"), ("b", "a"))
    paths = [r.path for r in expand.trails(starts(spark, "a"), ring, 5).collect()]
    assert sorted(paths) == [["a"], ["a", "b"], ["a", "b", "a"]]


def _nearest(all_trails, goals, k):
    """Trails to goals up to the length of each start's k-th shortest."""
    out = set()
    for start in {s for s, _ in all_trails}:
        own = sorted((p for s, p in all_trails if s == start and p[-1] in goals), key=len)
        out |= {(start, p) for p in own if len(own) < k or len(p) <= len(own[k - 1])}
    return out


@pytest.mark.parametrize("seed, k", [(1, 1), (2, 3), (3, 8), (4, 1000)])
def test_nearest_trails_are_the_shortest_of_all(spark, seed, k):
    draw = random.Random(seed)
    graph = edges(spark, *((f"n{draw.randint(0, 8)}", f"n{draw.randint(0, 8)}") for _ in range(18)), ("n0", "n0"), ("n0", "n1"), ("n0", "n1"))
    begin = spark.createDataFrame([("s", "n0"), ("s", "n1"), ("t", "n2"), ("t", "n2"), ("u", "n3"), ("v", "nowhere")], "start string, node string")
    goals = spark.createDataFrame([("n4",), ("n5",), ("n0",)], "node string")
    every = {(r.start, tuple(r.path)) for r in expand.trails(begin, graph, 4).collect()}
    got = [(r.start, tuple(r.path)) for r in expand.nearest_trails(begin, graph, goals, 4, k).collect()]
    assert len(got) == len(set(got)) and set(got) == _nearest(every, {"n4", "n5", "n0"}, k)


def test_a_cycle_on_the_way_is_no_sure_arrival(spark):
    # a > b > c > b would have to use b > c again to arrive at d, so it is none of the two trails
    graph = edges(spark, ("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"))
    goals = spark.createDataFrame([("d",)], "node string")
    assert [r.path for r in expand.nearest_trails(starts(spark, "a"), graph, goals, 6, 2).collect()] == [["a", "b", "c", "d"]]


def test_nearest_trails_of_numbered_nodes(spark):
    graph = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    begin, goals = spark.createDataFrame([(9, 1)], "start long, node long"), spark.createDataFrame([(3,)], "node long")
    assert sorted(r.path for r in expand.nearest_trails(begin, graph, goals, 3, 2).collect()) == [[1, 2, 3], [1, 3]]
    assert [r.path for r in expand.nearest_trails(begin, graph, goals, 3, 1).collect()] == [[1, 3]]


def test_no_goal_no_trail(spark):
    none = spark.createDataFrame([], "node string")
    assert expand.nearest_trails(starts(spark, "a"), edges(spark, ("a", "b")), none, 3, 2).count() == 0


def test_neighbours_are_undirected(spark):
    nodes = spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in expand.neighbours(nodes, edges(spark, ("a", "b"), ("b", "c"), ("c", "d"))).collect()} == {"a", "b", "c"}


@pytest.mark.parametrize("kind, score", [("LOW", 81.9), ("MEDIUM", 67.0), ("HIGH", 36.8), ("CRITICAL", 13.5)])
def test_score_of_equal_findings(spark, kind, score):
    f = spark.createDataFrame([(kind, "open")] * 3 + [("CRITICAL", "resolved")], "raw_severity string, status string")
    assert severity.scores(f, "raw_severity").first().score_exp == score


def test_score_without_findings(spark):
    r = severity.scores(spark.createDataFrame([], "contextual_severity string, status string")).first()
    assert (r.score_exp, r.score_linear, r.reading) == (100.0, 100, "GOOD")


def test_severity_is_held_to_its_scale(spark):
    df = spark.createDataFrame([("CRITICAL", 2), ("INFO", -1), ("odd", 0), (None, 1)], "s string, by int")
    got = [r[0] for r in df.select(C.severity_name(C.moved(C.severity_index(F.col("s")), F.col("by")))).collect()]
    assert got == ["CRITICAL", "INFO", "MEDIUM", "HIGH"]


@pytest.mark.parametrize("new, old, way, delta", [(90.0, 70.0, "improving", 20.0), (50.0, 80.0, "degrading", -30.0), (80.0, 79.5, "stable", 0.5)])
def test_trend(spark, new, old, way, delta):
    s = spark.createDataFrame([("r", "b", 2, new), ("r", "a", 1, old)], "repo string, commit_sha string, day int, score double")
    r = history.trend(s, 10).first()
    assert (r.direction, r.delta) == (way, delta)


def test_upsert_takes_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "k int, v string, o int")
    assert {(r.k, r.v) for r in history.upsert(old, new, ["k"], "o").collect()} == {(1, "a"), (2, "d"), (3, "e")}


def test_stale_nodes_go_unless_rebuilt(spark):
    nodes = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "g")], "uid string, file string")
    changed, rebuilt = spark.createDataFrame([("f",)], "file string"), spark.createDataFrame([("a",)], "uid string")
    kept, left = history.delete_stale(nodes, edges(spark, ("a", "c"), ("b", "c"), ("c", "b")), changed, rebuilt)
    assert {r.uid for r in kept.collect()} == {"a", "c"}
    assert {(r.src, r.dst) for r in left.collect()} == {("a", "c")}


def test_summary(spark):
    rows = [([], 0, 0, 0.0, 90.0), (["sast", "config", "function"], 1, 0, 3.5, 60.0), ([], 0, 2, -1.0, 99.9)]
    got = [r.summary for r in history.summary(spark.createDataFrame(rows, "types array<string>, n_removed int, n_chains int, delta double, score double")).collect()]
    assert got == [
        "Posture NEUTRAL (score: 90.0/100).",
        "Posture DEGRADED by 3.5 points (score: 60.0/100). 2 new finding(s), 1 node(s) removed.",
        "Posture IMPROVED by 1.0 points (score: 99.9/100). 2 new vulnerability chain(s).",
    ]


def test_containing_function_prefers_path_then_span(spark):
    fns = spark.createDataFrame([(1, "x/u.py", 1, 300), (2, "x/u.py", 100, 140), (3, "y/u.py", 119, 121), (4, "x/u.py", 119, 121)], "fn int, file string, start int, end int")
    found = spark.createDataFrame([(1, "x/u.py", 120), (2, "z/u.py", 120), (3, "x/u.py", 999), (4, "x/u.py", 64)], "find int, file string, line int")
    assert {r.find: r.fn for r in match.containing(found, fns).collect()} == {1: 4, 2: 3, 4: 1}


def test_kappa(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "c")], "truth string, guess string")
    assert match.kappa(same).first().kappa == 1.0
    flat = spark.createDataFrame([("a", "a"), ("b", "a")], "truth string, guess string")
    assert match.kappa(flat).first().kappa == 0.0


def test_signature():
    good = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert events.signed(b"body", good, "k")
    assert not events.signed(b"body", good, "")
    assert not events.signed(b"body", None, "k")
    assert not events.signed(b"other", good, "k")


def test_route_drops_what_is_not_to_be_analysed(spark):
    rows = [
        (1, "push", '{"after":"a","ref":"refs/heads/main","repository":{"full_name":"r"},"commits":[{"added":["b.py","a.md"],"modified":["a.md"]}]}'),
        (2, "push", '{"after":"%s","commits":[{"added":["x"]}]}' % ("0" * 40)),
        (3, "push", '{"after":"a","commits":[]}'),
        (4, "ping", "{}"),
        (5, "pull_request", '{"action":"closed","pull_request":{"head":{"sha":"s"}}}'),
        (6, "pull_request", '{"action":"reopened","number":7,"pull_request":{"head":{"sha":"s","ref":"f"}}}'),
        (7, "push", "not json"),
        (8, "push", '{"commits":[{"id":"c1"},{"id":"c2"}]}'),
    ]
    got = {r.id: r for r in events.route(spark.createDataFrame(rows, "id int, kind string, payload string")).collect()}
    assert set(got) == {1, 6, 8}
    assert (got[1].files, got[1].branch, got[1].relevant) == (["a.md", "b.py"], "main", True)
    assert (got[6].number, got[6].relevant, got[8].sha) == (7, True, "c2")


def test_comment(spark):
    from rampart.operators import deliver

    row = ("abcdef0123", "HIGH", True, ["one", "two"], 3, 2.5, "x" * 2500)
    df = spark.createDataFrame([row], "commit_sha string, risk_level string, requires_block boolean, top_issues array<string>, finding_count int, delta double, analysis string")
    text = deliver.comment(df).first().comment
    assert "| Risk | 🟠 HIGH |" in text and "| Commit | abcdef01 |" in text and "held until mended" in text and "worse by 2.5" in text and "1. one\n2. two" in text
    assert text.endswith("x …") and "x" * 2001 not in text


def test_importers_leave_out_changed_files(spark):
    from rampart.operators import scope

    imports = spark.createDataFrame([("a.py", "pkg.m"), ("b.py", ".m"), ("c.py", "other"), ("pkg/m.py", "pkg.m")], "path string, module string")
    changed = spark.createDataFrame([("pkg/m.py",), ("README.md",)], "path string")
    more = scope.importers(imports, changed)
    assert {r.path for r in more.collect()} == {"a.py", "b.py"}
    assert {(r.path, r.kind) for r in scope.affected(changed, more).collect()} == {("a.py", "code"), ("b.py", "code"), ("pkg/m.py", "code")}
