"""Commits over a stored graph: equal to a full rebuild after any sequence, files written by the change, imports refreshed."""

import random

import pytest
from pyspark.sql import functions as F

from rampart.operators import build, rules, severity, stored
from rampart.operators.expand import reach
from rampart.sources import code
from rampart.streaming import commits
from tests.test_repository import SCAN

ROUTE = '@app.route("/{name}/{k}"{auth})\n{deco}def view_{k}({arg}):\n    {body}\n\n'


def module(rng, k, functions):
    """Source of a file with functions that call those of other files, some with routes, some at a store."""
    text = "import flask\nfrom flask import Flask, request\napp = Flask(__name__)\n"
    others = [f"m{j}" for j in rng.sample(range(6), 2)]
    text += "".join(f"from {o} import f0, f1\n" for o in others[:1]) + f"import {others[1]}\n\n"
    for f in range(functions):
        body = rng.choice((f"return {others[1]}.f{rng.randrange(3)}()", "return f1()", 'cursor.execute("SELECT * FROM users")', 'cursor.execute("SELECT * FROM users WHERE name = " + name)', "pass", "return 1"))
        text += f"def f{f}(name=None):\n    {body}\n\n"
    for r in range(rng.randrange(0, 3)):
        text += ROUTE.format(name=f"m{k}", k=r, auth=rng.choice(("", ', methods=["POST"]')), deco=rng.choice(("", "@login_required\n")), arg="", body=rng.choice((f"return f{rng.randrange(functions)}()", f"return {others[1]}.f0()", 'name = request.form["a"]\n    return f0(name)')))
    return text


def built(spark, texts, paths=None, known=None):
    own = {p: t for p, t in texts.items() if paths is None or p in paths}
    facts = code.facts(spark.createDataFrame(sorted(own.items()), "path string, text string")).cache()
    scans = [("bandit", "B608", "Possible SQL injection", "MEDIUM", "CWE-89", p, k + 1) for p, t in sorted(own.items()) for k, line in enumerate(t.split("\n")) if '" + name' in line]
    g = build.graph(facts, scans=spark.createDataFrame(scans, SCAN), known=known)
    imports = facts.where("kind = 'imports'").select(F.col("file").alias("path"), F.explode("items").alias("module")).distinct()
    return g, imports


def rows(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).distinct().collect())


def same(g, want):
    for name, columns in {"functions": ("fn", "file", "tainted"), "calls": ("src", "dst"), "endpoints": ("ep", "path", "is_public"), "handled_by": ("ep", "fn"), "access": ("fn", "ds", "access"), "findings": ("f", "file", "cwe_id"), "affects": ("f", "fn")}.items():
        assert rows(getattr(g, name), *columns) == rows(getattr(want, name), *columns), name
    starts = want.handled_by.select(F.col("ep").alias("start"), F.col("fn").alias("node"))
    assert rows(g.memo["reach", rules.MOST_HOPS], "ep", "fn", "depth") == rows(reach(starts, want.calls, rules.MOST_HOPS), "start", "node", "depth")
    assert rows(rules.all_chains(g), "rule", "f", "ds", "ep_path", "has_taint") == rows(rules.all_chains(want), "rule", "f", "ds", "ep_path", "has_taint")
    assert rows(severity.rated(g), "f", "contextual_severity") == rows(severity.rated(want), "f", "contextual_severity")


def test_commits_equal_a_full_rebuild(spark, tmp_path):
    rng = random.Random(5)
    texts = {f"m{k}.py": module(rng, k, 3) for k in range(6)}
    store = stored.open_store(spark, f"file://{tmp_path}/store", buckets=4)
    stored.begin(store, *built(spark, texts))
    for step in range(2):
        changed = rng.sample(sorted(texts), 1 + step)
        for p in changed:
            texts[p] = module(rng, int(p[1]), 3)
        everything = built(spark, texts)[0]
        names = [r.fn for r in everything.functions.select("fn").collect()]
        known = spark.createDataFrame([(n,) for n in names], "fn string")
        rebuild = lambda paths: built(spark, texts, {r.path for r in paths.collect()}, known)  # noqa: E731, B023
        paths = spark.createDataFrame([(p,) for p in changed], "path string")
        assert stored.commit(store, f"c{step}", f"2026-01-0{step + 1}", "r", paths, rebuild, step).first().commit_sha == f"c{step}"
        assert stored.commit(store, f"c{step}", "2026-01-09", "r", paths, rebuild, step) is None
    assert [r.commit_sha for r in store.read("snapshots").orderBy("ts").collect()] == ["c0", "c1"]
    assert store.vacuum() > 0
    same(stored.load(store), everything)


def test_a_small_commit_writes_few_buckets_and_a_failed_one_nothing(spark, tmp_path):
    texts = {f"a{k}.py": f"def g{k}():\n    return h{k}()\n\ndef h{k}():\n    pass\n" for k in range(30)} | {"m.py": "def one():\n    pass\n"}
    store = stored.open_store(spark, f"file://{tmp_path}/store", buckets=32)
    stored.begin(store, *built(spark, texts))
    whole = store.written
    changed = spark.createDataFrame([("m.py",)], "path string")

    def fail(paths):
        raise RuntimeError("no such commit")

    with pytest.raises(RuntimeError):
        stored.commit(store, "c", "2026", "r", changed, fail)
    assert store.manifests() == [0]
    texts["m.py"] = "def two():\n    pass\n\ndef one():\n    return two()\n"
    stored.commit(store, "c", "2026", "r", changed, lambda paths: built(spark, texts, {r.path for r in paths.collect()}))
    assert store.written <= 12 < whole / 3
    assert ("m.one", "m.two") in {(r.src, r.dst) for r in store.read("calls").collect()}


def test_a_stream_of_commits_refreshes_imports(spark, tmp_path):
    first = {"app.py": "def a():\n    pass\n", "db.py": "def q():\n    pass\n"}
    second = first | {"app.py": "import db\n\ndef a():\n    return db.q()\n"}  # app.py begins to import db
    third = second | {"db.py": "def q():\n    return r()\n\ndef r():\n    pass\n"}
    texts, asked, told = {"c1": second, "c2": third}, [], []
    store = stored.open_store(spark, f"file://{tmp_path}/store", buckets=2)
    stored.begin(store, *built(spark, first))

    def rebuild(sha, paths):
        own = {r.path for r in paths.collect()}
        asked.append((sha, own))
        return built(spark, texts[sha], own, spark.createDataFrame([("app.a",), ("db.q",), ("db.r",)], "fn string"))

    kind, folder = "sha string, repo string, files array<string>, ts string", tmp_path / "pushes"
    follow = lambda: commits.follow(spark.readStream.schema(kind).parquet(str(folder)), store, f"{tmp_path}/state", rebuild, lambda d: told.append(d.first().commit_sha))
    spark.createDataFrame([("c1", "r", ["app.py"], "2026-01-01")], kind).write.parquet(str(folder))
    follow()
    spark.createDataFrame([("c2", "r", ["db.py", "README.md"], "2026-01-02")], kind).write.mode("append").parquet(str(folder))
    follow()
    follow()
    assert asked == [("c1", {"app.py"}), ("c2", {"app.py", "db.py"})] and told == ["c1", "c2"]
    assert {r.commit_sha for r in store.read("snapshots").collect()} == {"c1", "c2"} and len(store.manifests()) == 2
    assert ("app.a", "db.q") in {(r.src, r.dst) for r in stored.load(store).calls.collect()}
