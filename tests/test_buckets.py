"""Tables in buckets: what a commit writes, what readers see, failed commits, and what vacuum leaves."""

import os

import pytest

from rampart.buckets import Buckets


def rows(spark, items):
    return spark.createDataFrame(items, "file string, n int")


@pytest.fixture
def store(spark, tmp_path):
    s = Buckets(spark, f"file://{tmp_path}", {"t": "file", "u": "file"}, buckets=8)
    s.commit({"t": (rows(spark, [(f"f{i}", i) for i in range(40)]), None), "u": (rows(spark, []), None)})
    return s


def files(store):
    root = store.folder.removeprefix("file://")
    return {os.path.join(d, n) for d, _, names in os.walk(root) for n in names if n.endswith(".parquet")}


def test_a_commit_writes_the_buckets_that_it_touches(spark, store):
    before = files(store)
    new = rows(spark, [("f3", 300), ("f3", 301)])
    own = store.touched(new, "file")
    assert len(own) == 1
    kept = store.read("t", own).where("file <> 'f3'")
    assert 0 < kept.count() < 39
    store.commit({"t": (kept.union(new), own)})
    assert store.written == 1 and len(files(store) - before) == 1 and before <= files(store)
    assert {(r.file, r.n) for r in store.read("t").collect()} == {(f"f{i}", i) for i in range(40) if i != 3} | {("f3", 300), ("f3", 301)}
    assert store.read("t", version=0).count() == 40
    assert store.vacuum() >= 1 and len(files(store)) == len(before) and store.read("t").count() == 41


def test_an_emptied_bucket_and_an_empty_table(spark, store):
    own = store.touched(rows(spark, [("f3", 0)]), "file")
    gone = store.read("t", own).count()
    store.commit({"t": (rows(spark, []), own)})
    assert store.read("t").count() == 40 - gone and store.read("t", own).count() == 0 and store.written == 0
    assert store.read("u").columns == ["file", "n"] and store.read("u").count() == 0


def test_a_failed_commit_leaves_the_old_manifest(spark, store):
    from pyspark.sql import functions as F

    bad = rows(spark, [("f1", 1)]).withColumn("n", F.expr("if(n = 1, cast(raise_error('x') as int), n)"))
    good = rows(spark, [("f2", 2)])
    with pytest.raises(Exception, match="x"):
        store.commit({"u": (good, None), "t": (bad, store.touched(bad.select("file"), "file"))})
    assert store.manifests() == [0] and store.read("t").count() == 40 and store.read("u").count() == 0
    store.commit({"u": (good, None)})
    assert store.read("u").count() == 1 and store.read("t").count() == 40


def test_of_two_writers_of_one_version_one_fails(spark, store):
    other = Buckets(spark, store.folder, store.keys, buckets=8)
    m = other.manifest()
    m.version += 1
    other._put(m)
    with pytest.raises(Exception, match="exist"):
        other._put(m)
    assert store.manifest().version == 1


def test_a_tag_is_committed_once(spark, store):
    store.commit({"u": (rows(spark, [("a", 1)]), None)}, tag=5)
    store.commit({"u": (rows(spark, [("a", 1), ("b", 2)]), None)}, tag=5)
    assert store.read("u").count() == 1 and store.manifest().tag == 5
    store.commit({"u": (rows(spark, [("c", 1)]), None)}, tag=6)
    assert [r.file for r in store.read("u").collect()] == ["c"]


def test_a_draft_may_put_a_table_twice(spark, store):
    a, b = store.touched(rows(spark, [("f3", 0)]), "file"), store.touched(rows(spark, [("f4", 0)]), "file")
    draft = store.draft()
    draft.put("t", rows(spark, [("f3", 1)]), a)
    draft.put("t", draft.read("t", b).where("file <> 'f4'"), b)
    if a == b:
        draft.put("t", draft.read("t", a).union(rows(spark, [("f3", 2)])), a)
    assert store.read("t").where("n = 1 and file = 'f3'").isEmpty()
    draft.publish()
    got = {r.file: r.n for r in store.read("t").collect()}
    assert got["f3"] in (1, 2) and "f4" not in got
    store.vacuum()
    assert {r.file: r.n for r in store.read("t").collect()} == got
