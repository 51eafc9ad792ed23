"""Steps whose rows must not grow faster than their input: groups of equal rows meet as one."""

import pyarrow as pa
from pyspark.sql import functions as F

from rampart import catalog
from rampart.operators import evaluate, expand, match, rules
from rampart.plans.projection import project
from tests.rows import most_rows


def test_lines_and_functions_of_a_place_do_not_multiply(spark):
    fns = spark.range(400).selectExpr("id as fn", "concat('a/f', id % 2, '.py') as file", "cast(10 + id % 5 as int) as start", "cast(40 + id % 7 as int) as end")
    found = spark.range(400).selectExpr("id as find", "concat(if(id % 3 = 0, 'b/f', 'a/f'), id % 2, '.py') as file", "cast(id % 50 as int) as line")
    f, g = fns.collect(), found.collect()
    want = {}
    for x in g:
        held = [y for y in f if y.file[1:] == x.file[1:] and y.start <= x.line <= y.end]
        if held:
            want[x.find] = min(held, key=lambda y: (y.file != x.file, y.end - y.start, y.start, y.fn)).fn
    rows, most = most_rows(match.containing(found, fns))
    assert {r.find: r.fn for r in rows} == want and len(rows) == len(want)
    assert most <= 4000  # pairs of the same place: some 50,000


def test_findings_that_say_the_same_meet_known_ones_once(spark):
    known = spark.range(120).selectExpr("id as gid", "if(id % 3 = 0, null, concat('CWE-', id % 4)) as cwe_id", "concat('m', id % 5, '.py') as file", "'Unsafe call of it' as title")
    found = spark.range(300).selectExpr("id as f", "concat('CWE-', id % 7) as cwe_id", "if(id % 11 = 0, null, concat('src/m', id % 6, '.py')) as file", "if(id % 2 = 0, 'UNSAFE thing', null) as title")
    found = found.union(found.where("f % 10 = 0").selectExpr("f", "'CWE-1'", "'x/m2.py'", "'unsafe'"))  # some say two things
    pairs = match.truth(found, known)
    want = {(r.gid, r.hits, r.first) for r in pairs.groupBy("gid").agg(F.count("f").alias("hits"), F.min("f").alias("first")).collect()}
    rows, most = most_rows(match.truth_counts(found, known))
    assert {(r.gid, r.hits, r.first_match) for r in rows} == want and len(rows) == len(want) > 100
    assert most < 3000 < pairs.count()


def test_met_findings_never_meet_each_rule_s_rows(spark):
    """The findings that rules meet are those of their rows, of which there are many more."""
    g = project(spark, "/root/testdata/sf0.001")
    g.findings = g.findings.withColumn("type", F.lit("dependency"))
    g.affects_dep = g.findings.select("f", F.lit("Brand#11").alias("dep"))
    g.uses = g.functions.select("fn", F.lit("Brand#11").alias("dep"))
    want = rules.all_chains(g).select("f").union(rules.rule3_supply_chain(g).select("f")).distinct()
    assert sorted(rules.chained_findings(g).collect()) == sorted(rules.all_chains(g).select("f").distinct().collect())
    rows, most = most_rows(rules.reachable_findings(g))
    assert sorted(rows) == sorted(want.collect()) and rows
    assert most <= 10_000 < rules.rule3_supply_chain(g).count()


def test_reach_reads_its_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def one(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    edges = spark.range(50).selectExpr("id as src", "id + 1 as dst").mapInArrow(one, "src long, dst long")
    starts = spark.createDataFrame([(0, 0)], "start long, node long")
    assert {(r.node, r.depth) for r in expand.reach(starts, edges, 5).collect()} == {(i, i) for i in range(6)}
    assert seen.value == 50


def test_scanner_rows_are_brought_to_one_a_test_before_they_are_dealt(spark):
    known = spark.createDataFrame([("a", "HIGH", ["t1", "t0"]), ("b", "LOW", ["t9"])], "gid string, raw string, tests array<string>")
    scans = spark.range(2000).selectExpr("concat('t', id % 2) as rule_id", "if(id < 4, 'LOW', 'HIGH') as severity", "2000 - id as seq")
    told = evaluate.scanner(scans, known)
    assert {(r.gid, r.detected, r.severity, r.underrated) for r in told.collect()} == {("a", True, "HIGH", False), ("b", False, None, False)}
    assert "Aggregate [rule_id" in told._jdf.queryExecution().optimizedPlan().toString()


def test_engine_takes_the_first_finding_of_those_that_say_the_same(spark):
    known = spark.createDataFrame([("a", "CWE-1", "HIGH", "x.py", "An unsafe call")], "gid string, cwe_id string, contextual string, file string, title string")
    found = spark.range(3000).selectExpr("id as f", "if(id % 2 = 0, 'CWE-1', 'CWE-2') as cwe_id", "'s/x.py' as file", "if(id > 6, 'unsafe', 'no') as title", "'LOW' as raw_severity", "if(id = 0, 'HIGH', 'LOW') as contextual_severity")
    rows, most = most_rows(evaluate.engine(found.where("f <> 2"), known))
    assert [tuple(r) for r in rows] == [("a", True, "HIGH", True, True)]
    assert match.truth(found, known).count() > 2990


def test_trails_carry_only_what_is_asked_of_them(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (1, 2, "c"), (2, 3, None), (3, None, "d")], "src int, dst int, evidence string")
    p = expand.paths(edges, 4)
    got = {(tuple(r.nodes), tuple(r.evidence), r.first, r.length) for r in p.collect()}
    want, now = set(), {((s, d), (e,)) for s, d, e in map(tuple, edges.collect())}
    while now and len(next(iter(now))[1]) <= 4:
        want |= {(n, e, e[0], len(e)) for n, e in now}
        now = {(n + (d,), e + (w,)) for n, e in now for s, d, w in map(tuple, edges.collect()) if s == n[-1] and (s, d) not in zip(n, n[1:])}
    assert got == want
    plan = p.select("start", "node", "length", "nodes")._jdf.queryExecution().optimizedPlan().toString()
    assert "concat(evidence" not in plan and "used" not in plan


def test_files_are_parsed_once_for_a_query(spark, monkeypatch):
    """what reads facts more than once reads them written."""
    from rampart.sources import code

    parsed, reads, facts = spark.sparkContext.accumulator(0), {"parse_functions": 1, "parse_calls": 1, "uses_edges": 1, "endpoint_extract": 1, "missing_auth_findings": 1}, code.facts

    def counted(files, *kinds):
        def one(batches):
            for batch in batches:
                parsed.add(batch.num_rows)
                yield batch

        return facts(files.mapInArrow(one, "path string, text string"), *kinds)

    monkeypatch.setattr(code, "facts", counted)
    n = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    for name, times in reads.items():
        before = parsed.value
        catalog.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert parsed.value - before == times * n, name


def test_a_worker_holds_few_facts():
    """a batch of many files gives many small batches of facts."""
    from rampart.sources import code

    files = pa.RecordBatch.from_pydict({"path": [f"a/m{i}.py" for i in range(3000)], "text": ["def f(x):\n    eval(x)\n"] * 3000})
    sizes = [b.num_rows for b in code.parsed(iter([files]))]
    assert sum(sizes) == 12_000 and max(sizes) < code.HELD + 4
    assert {r["kind"] for b in code.parsed(iter([files]), frozenset(["taint"])) for r in b.to_pylist()} == {"taint"}


def test_documents_are_scored_where_they_lie(spark, monkeypatch):
    """no row for each pair of a query and a document; the same rows by passes of few words."""
    from rampart.operators import inverted, retrieval

    docs = spark.range(400).selectExpr("id div 2 as id", "if(id % 50 = 0, null, concat('a\\tB ', id % 7, ' ', id % 5, ' ', id % 5, if(id % 3 = 0, ' c', ''))) as text")
    asked = spark.range(30).selectExpr("id as query_id", "concat('A a ', id % 7, ' ', id % 6, if(id = 3, ' nowhere', '')) as text").union(spark.sql("select 99L, 'nowhere'"))
    rows, most = most_rows(retrieval.bm25(docs, asked, 3))
    assert len(rows) == 93 and most <= 2000 < 200 * 30
    words = inverted.build(docs)
    assert sorted(rows) == sorted(retrieval.bm25_indexed(words, docs, asked, 3).collect())
    for name, most in (("COUNTED", 4), ("SCORED", 40), ("QUERIES", 7), ("CELLS", 50)):
        monkeypatch.setattr(retrieval, name, most)
    assert sorted(rows) == sorted(retrieval.bm25(docs, asked, 3).collect())
    none = spark.createDataFrame([], docs.schema)
    assert retrieval.bm25(none, asked, 3).collect() == [] and retrieval.bm25(docs, asked.limit(0), 3).collect() == []


def test_vectors_do_not_meet_queries_as_rows(spark, monkeypatch):
    """a task sends its best on, ties to the smaller id, copies, odd vectors and passes of few queries included."""
    from rampart.operators import retrieval

    vectors = spark.range(900).selectExpr("id", "transform(sequence(1, 8), i -> cast(sin(i * (id % 300 + 1)) as float)) as v")
    asked = vectors.where("id % 30 = 0").selectExpr("id as query_id", "v as q")
    rows, most = most_rows(retrieval.dense(vectors, asked, 4))
    want = retrieval._top(retrieval._pairs(vectors, asked).withColumn("score", F.round("score", 9)), 4).collect()
    assert sorted(rows) == sorted(want) and len(rows) == 120 and most <= 3000 < 900 * 30
    assert {r.id for r in rows if r.query_id == 600 and r["rank"] <= 3} == {0, 300, 600}
    monkeypatch.setattr(retrieval, "COMPONENTS", 64)
    monkeypatch.setattr(retrieval, "CELLS", 50)
    odd = vectors.selectExpr("id", "case when id = 7 then null when id = 8 then array(float(1), null) when id = 9 then slice(v, 1, 3) when id = 60 then transform(v, x -> x * float(1e30)) else v end as v")
    odd = odd.withColumn("v", F.col("v").cast("array<double>")).withColumn("v", F.expr("if(id = 61, transform(v, x -> x * 1e120), v)"))
    some = odd.where("id % 30 = 0 or id = 9").selectExpr("id as query_id", "v as q")
    want = retrieval._top(retrieval._pairs(odd, some).withColumn("score", F.round("score", 9)), 4).collect()
    assert sorted(retrieval.dense(odd, some, 4).collect()) == sorted(want)
    few = retrieval.dense(odd.where("id in (7, 9, 30)"), some.where("query_id = 30"), 4).collect()
    assert [(r["rank"], r.id, r.score) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 30, 1.0), (2, 7, None), (3, 9, None)]
    assert retrieval.dense(odd.limit(0), some, 4).collect() == [] and retrieval.dense(odd, some.limit(0), 4).collect() == []


def test_upserts_are_dealt_to_more_tasks_as_they_grow(spark, monkeypatch, tmp_path):
    """no task's part of the new generation grows with it."""
    from rampart.operators import history

    spark.range(3000).selectExpr("id % 1000 as src", "id % 7 as dst", "id as o").write.parquet(str(tmp_path / "e"))
    new = spark.read.parquet(str(tmp_path / "e"))
    want = sorted(history.upsert_edges(new.where("o < 900"), new.where("o >= 500"), "o").collect())
    monkeypatch.setattr(history, "TASK_BYTES", 1000)
    told = history.upsert_edges(new.where("o < 900"), new.where("o >= 500"), "o")
    assert sorted(told.collect()) == want and len(want) == len({(r.src, r.dst) for r in want})
    assert history.dealt(new, "src", "dst").rdd.getNumPartitions() > 4


def test_rows_of_one_dependency_are_made_by_several_tasks(spark, monkeypatch):
    """Rule 3 gives findings times uses of a dependency: more than one task of a dependency shares them."""
    monkeypatch.setattr(rules, "TASK_ROWS", 2000)
    g = project(spark, "/root/testdata/sf0.001")
    g.affects_dep = g.findings.where("type = 'dependency'").select("f", F.lit("Brand#11").alias("dep"))
    g.uses = g.functions.select("fn", F.lit("Brand#11").alias("dep"))
    public = g.endpoints.where("is_public").select("ep", "path")
    used = rules.endpoint_reach(g, 5).join(public, "ep").select("path", "fn", "depth").distinct()
    want = used.crossJoin(g.affects_dep).select("f", "dep", "path", "fn", "depth")
    rows = rules.rule3_supply_chain(g).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    assert sorted(tuple(r)[:5] for r in rows) == sorted(map(tuple, want.collect())) and len(rows) > 4000


def test_rule_3_takes_as_many_tasks_as_its_rows_ask_for(spark, monkeypatch):
    """no dependency is bound to a number of tasks, lists of findings are bounded, and findings told twice count once."""
    monkeypatch.setattr(rules, "TASK_ROWS", 100)
    monkeypatch.setattr(rules, "MOST_FINDINGS", 7, raising=False)
    g = project(spark, "/root/testdata/sf0.001")
    of = F.when(F.col("f") % 50 == 0, "Brand#12").when(F.col("f") % 70 == 0, F.lit(None)).when(F.col("f") == 10, "none uses it").otherwise("Brand#11")
    g.affects_dep = g.findings.where("type = 'dependency'").select("f", of.alias("dep"))
    g.uses = g.functions.select("fn", F.when(F.col("fn") % 5 == 0, "Brand#12").when(F.col("fn") % 7 > 0, "Brand#11").alias("dep"))
    public = g.endpoints.where("is_public").select("ep", "path")
    used = rules.endpoint_reach(g, 5).join(public, "ep").join(g.uses, "fn").select("path", "fn", "depth", "dep").distinct()
    want = sorted(map(tuple, used.join(g.affects_dep, "dep").select("f", "dep", "path", "fn", "depth").collect()))
    g.affects_dep = g.affects_dep.union(g.affects_dep)
    rows = rules.rule3_supply_chain(g).withColumn("task", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:5] for r in rows) == want and len({r.dep for r in rows}) == 2 and len(rows) > 4000
    assert len({r.task for r in rows if r.dep == "Brand#11"}) > 32
    g.findings = g.findings.limit(0)
    assert rules.rule3_supply_chain(g).collect() == []
