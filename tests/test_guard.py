"""The guard of statements: what may run, what may not, and mixtures of both; and named questions."""

import random

import pytest

from rampart.plans import ask, guard
from rampart.plans.projection import project, snapshots

SF = "/root/testdata/sf0.001"
VIEWS = ["findings", "affects"]
GOOD = [
    'select 1',
    'values (1),(2)',
    'select f, fn from findings join affects using (f) where cwe_id = :c',
    'with a as (select f from findings), b as (select * from a) select count(*) from b where f in (select f from affects)',
    'select cwe_id, count(distinct f) n, max(f) filter (where f>1) m from findings group by cwe_id having count(*) > 0 order by n desc limit 5 offset 0',
    "select 'drop table x' as a",
    "select 'reflect(x)' as a -- drop\n",
    'select *, row_number() over (partition by cwe_id order by f desc) r, sum(f) over w s from findings window w as (order by f rows between unbounded preceding and current row)',
    "select case when f = 1 then 'x' else 'y' end c, nvl(cwe_id,'z'), concat(cwe_id, '-', f), cast(f as string), f::double, f between 1 and 2, cwe_id like 'a%', cwe_id rlike 'a', f in (1,2), not f = 1, -f, f+1, f/2, f%2 from findings",
    'select explode(array(f, 2)) e from findings',
    'select * from findings lateral view explode(array(1,2)) t as e',
    'select f from findings union all select fn from affects',
    'select f from findings except select f from affects',
    'select (select max(f) from affects) m, exists(select 1 from affects a where a.f = x.f) e from findings x',
    'select transform(array(f), v -> v + 1) t, filter(array(1,2), v -> v > 1) from findings',
    'select a.f from findings a left semi join affects b on a.f = b.f',
    "select distinct cwe_id from findings where f is not null and cwe_id <=> 'a'",
    "select collect_set(cwe_id) s, string_agg(cwe_id, ',') from findings",
    "select date_add(to_date('2024-01-01'), 3) d, year(to_date('2024-01-01')), upper(substring(cwe_id,1,2)), round(f*1.5,1), coalesce(null, f), if(f>1,1,0), ifnull(null,2), nullif(1,2), startswith('ab','a'), contains('ab','b'), left('abc',2), split('a,b',',')[0], struct(1 as a).a, map('a',1)['a'] from findings",
    'select cwe_id, f from findings group by all',
    'select cwe_id, count(*) from findings group by grouping sets ((cwe_id), ())',
    'select cwe_id, count(*) from findings group by rollup(cwe_id)',
    'table findings',
    'select * from findings tablesample (1 rows)',
    "select lpad(cwe_id, 3, 'x'), rpad(cwe_id,3,'x'), endswith(cwe_id,'a'), ceil(1.5), floor(1.5), md5(cwe_id), sha2(cwe_id,256), length(cwe_id), lower(cwe_id), trim(cwe_id), regexp_replace(cwe_id,'a','b'), median(f) over (), date_format(to_timestamp('2024-01-01'),'y'), dense_rank() over (order by f), lag(f) over (order by f), element_at(array(1),1), array_contains(array(f),1), greatest(f,2), get(array(1),0), try_divide(f,0), string_agg(cwe_id, ',') over () from findings",
    'select posexplode(array(1)) from findings',
    "select first_value(f), percentile(f,0.5), approx_percentile(f,0.5), std(f), any_value(f), bool_or(f>1), count_if(f>1), max_by(f,cwe_id), array_join(array_sort(collect_list(cwe_id)),','), mode(f), every(f>0), corr(f,f), array_agg(f) from findings",
    'from findings select f',
]
BAD = [
    "select transform(a) using 'id -un' as (b string) from values (1) as t(a)",
    "from values (1) t(a) map a using 'id' as b",
    "from values (1) t(a) reduce a using 'id' as b",
    'select "--", reflect(\'java.util.UUID\',\'randomUUID\')',
    'select "\'" as a, java_method(\'java.util.UUID\',\'randomUUID\'), "\'" as c',
    'drop table x',
    'select 1; select 2',
    'insert into t values (1)',
    'with a as (select 1) delete from t',
    'show tables',
    'select * from secret',
    'select * from parquet.`/tmp`',
    'select * from text.`/etc/passwd`',
    'select * from `parquet`.`/x`',
    "select try_reflect('a','b')",
    'select input_file_name() from findings',
    "select * from read_files('/etc')",
    'select * from range(10)',
    'select current_user()',
    'select session_user',
    'set spark.x=1',
    'create table x as select 1',
    'cache table findings',
    'select * from global_temp.findings',
    'select * from default.findings',
    'with findings as (select * from secret) select * from findings',
    'select * from (select * from parquet.`/etc`)',
    'select (select count(*) from secret)',
    'select f from findings where f in (select id from secret)',
    "select raise_error('x')",
    'select rand()',
    'select uuid()',
    'select version()',
    'explain select 1',
    'describe findings',
    'begin select 1; end',
    "execute immediate 'select 1'",
    "select * from identifier('secret')",
    "select * from python_table('x')",
    'select sleep(1)',
    "select aes_decrypt('a','b')",
    'use x',
    'refresh table findings',
    "add jar '/x'",
    'select * from stream findings',
    "select from_json('{}','a int')",
    "select /*+ broadcast(findings) */ identifier('f') from findings",
    'merge into t using s on 1=1 when matched then delete',
    'select evil(f) from findings',
    'call x()',
    'with recursive r(n) as (select 1 union all select n+1 from r) select * from r',
    "select e from findings lateral view java_method('a','b') t as e",
    "select sum(f) filter (where java_method('a','b') = 'x') from findings",
    "select f from findings window w as (order by java_method('a','b'))",
    "select * from values (java_method('java.util.UUID','randomUUID'))",
    "select * from findings order by reflect('a','b')",
    "select * from findings limit cast(java_method('a','b') as int)",
    "select * from findings pivot (max(f) for cwe_id in ('a'))",
    "select reflect('java.lang.System', 'exit', 0)",
    "select `java_method`('a', 'b')",
    'select 1 from csv.`/etc/passwd`',
    'select * from "parquet" . `x`',
    "select /* */ try_reflect('a', 'b')",
    'select python_worker_logs()',
    'drop table t',
    '',
    ' ',
    'select upper(f',
    'select * from nowhere',
    'select no_column from findings',
]


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "a", "HIGH"), (2, "b", "LOW")], "f int, cwe_id string, raw_severity string").createOrReplaceTempView("findings")
    spark.createDataFrame([(1, 7)], "f int, fn int").createOrReplaceTempView("affects")
    spark.range(3).createOrReplaceTempView("secret")
    spark.udf.register("evil", lambda x: "evil")
    return spark


@pytest.mark.parametrize("text", GOOD)
def test_reading_statements_pass(views, text):
    guard.reading(views, text, VIEWS, {"c": "a"} if ":c" in text else None).collect()


@pytest.mark.parametrize("text", BAD)
def test_other_statements_are_refused(views, text):
    with pytest.raises(guard.Refused):
        guard.reading(views, text, VIEWS)


def test_whatever_holds_a_refused_piece_is_refused(views):
    """Pieces that reach out, put at random places of reading statements, quoted and commented in many ways."""
    rng = random.Random(11)
    calls = ["reflect('java.util.UUID', 'randomUUID')", "java_method('java.util.UUID', 'randomUUID')", "try_reflect('a', 'b')", "evil(f)", "input_file_name()", "`java_method`('a', 'b')", "Java_Method ('a', 'b')", "/* ' */ reflect('a', 'b') /* ' */"]
    tables = ["secret", "`secret`", "default.findings", "json.`/etc`", "(select * from secret)", "(select transform(1) using 'id' as (f string))", "range(3)", "`text`.`/etc/passwd`", "read_files('/etc')", "(table secret)"]
    shells = ["select {x} as a from {t}", "select '--', {x}, '--' from {t}", 'select "\'", {x} from {t}', "select f from {t} where {x} is null", "select count(*) from {t} group by {x}", "select f from {t} order by {x}", "with w as (select {x} as a, f from {t}) select * from w",
              "select (select max({x}) from {t}) as a", "select * from findings where f in (select {x} from {t})", "select max(f) filter (where {x} = 'a') from {t}", "select sum(f) over (partition by {x}) from {t}", "select f from {t} group by f having max({x}) is null",
              "select transform(array(1), v -> concat(v, {x})) from {t}", "select * from {t} union all select {x}, 'a', 'b' from findings", "select case when {x} = '' then 1 end from {t}", "select * from {t} join (select f from findings where {x} is null) using (f)", "select explode(array({x})) from {t}"]
    for _ in range(150):
        shell, bad_call = rng.choice(shells), rng.random() < 0.5
        text = shell.format(x=rng.choice(calls) if bad_call else "f", t="findings" if bad_call else rng.choice(tables))
        text = text.replace("select ", rng.choice(("select ", "SELECT\n", "select /* from findings */ ", "select -- x\n")), 1)
        with pytest.raises(guard.Refused):
            guard.reading(views, text, VIEWS)
    for shell in shells:
        text = shell.format(x="'a'" if "concat" in shell else "f", t="findings")
        guard.reading(views, text, VIEWS)


def test_a_function_in_a_listed_ones_place_is_refused(views):
    own = views.newSession()  # functions of a session are its own
    own.createDataFrame([("a",)], "cwe_id string").createOrReplaceTempView("findings")
    assert guard.reading(own, "select soundex(cwe_id) from findings", VIEWS).count() == 1
    own.udf.register("soundex", lambda x: "mine")
    with pytest.raises(guard.Refused):
        guard.reading(own, "select soundex(cwe_id) from findings", VIEWS)


def test_a_very_long_statement_is_refused(views):
    with pytest.raises(guard.Refused):
        guard.reading(views, "select " + " + ".join(["f"] * 6000) + " from findings", VIEWS)


@pytest.fixture(scope="module")
def graph(spark):
    return project(spark, SF)


def test_ask_sql_over_the_graph(spark, graph):
    ask.register(graph)
    assert ask.ask_sql(spark, "select 'drop table x' as a, :b as b;", {"b": 2}).first() == ("drop table x", 2)
    assert ask.ask_sql(spark, "select f from findings", most=20).count() == 20 and ask.ask_sql(spark, "select f from findings").count() > 20


@pytest.mark.parametrize("question, name, column", [
    ("What are the most critical open findings?", "worst findings", "contextual_severity"), ("Which public endpoints have no authentication?", "open endpoints", "path"), ("What vulnerability chains exist?", "chains", "evidence"),
    ("What PII datastores can be reached from public endpoints?", "personal data", "name"), ("What is the blast radius of the Brand#11 dependency?", "blast radius", "functions"), ("Has posture improved or degraded recently?", "posture trend", "score"),
    ("Which functions handle user input and access the database?", "input at stores", "stores"), ("Show me all SQL injection findings.", "sql injection", "fn"),
])
def test_named_questions(spark, graph, question, name, column):
    assert ask.understood(question)[0] == name
    rows = ask.answer(graph, question, snapshots(spark, SF)).collect()
    assert 0 < len(rows) <= ask.MOST_ROWS and column in rows[0].asDict()


def test_blast_radius_takes_the_name_that_is_asked_for(graph):
    want = graph.uses.where("dep = 'Brand#13'").select("fn").distinct().count()
    (row,) = ask.answer(graph, "blast radius of brand#13").collect()
    assert (row.dep, row.functions) == ("Brand#13", want)
    assert ask.answer(graph, "what is the blast radius of left-pad?").collect() == []


def test_other_questions(graph):
    assert ask.answer(graph, "what is the weather?") is None and ask.answer(graph, "has the score trend changed?") is None
    for bad in ("", "   ", "x" * 1001):
        with pytest.raises(ValueError):
            ask.answer(graph, bad)
