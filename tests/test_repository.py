"""A repository from its sources to graph, chains, severities, updates and reports."""

import pytest

from rampart.operators import build, deliver, evaluate, knowledge, match, rules, severity, update
from rampart.plans import ask
from rampart.sources import code, reports
from rampart.streaming import commits, events

APP = '''
import werkzeug
from flask import Flask, request
from db import get_user, list_users
app = Flask(__name__)

@app.route("/login", methods=["POST"])
def login():
    name = request.form["name"]
    return get_user(name)

@app.route("/admin/users")
def admin():
    return list_users()

@app.get("/health")
def health():
    return a().b()
'''
DB = '''
def get_user(name):
    cursor.execute("SELECT * FROM users WHERE name = '" + name + "'")

def list_users():
    cursor.execute("SELECT * FROM users")
'''
SCANS = [("bandit", "B608", "Possible SQL injection", "MEDIUM", "CWE-89", "./db.py", 3), ("bandit", "B105", "secret", "LOW", "CWE-798", "gone.py", 1)]
SCAN = "tool string, rule_id string, description string, severity string, cwe_id string, file string, line int"


def sources(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "name string, text string").selectExpr("concat(name, '.py') as path", "text")


def graph_of(spark, scans=SCANS, known=None, **texts):
    wanted = spark.createDataFrame([("Werkzeug", "2.0", True), ("Unused", None, False)], "name string, version string, pinned boolean")
    audit = spark.createDataFrame([("werkzeug", "CVE-1", "HIGH", "d"), ("werkzeug", "CVE-2", "LOW", "d"), ("other", "CVE-3", "HIGH", "d")], "package string, cve_id string, severity string, description string")
    issues = spark.createDataFrame([("config.py", 4, "debug_mode_enabled", "MEDIUM", "DEBUG = True")], "path string, n int, kind string, severity string, evidence string")
    return build.graph(code.facts(sources(spark, **texts)), wanted, spark.createDataFrame(scans, SCAN), audit, issues, "shop", known=known)


@pytest.fixture(scope="module")
def g(spark):
    return graph_of(spark, app=APP, db=DB)


def test_nodes_and_edges(g):
    assert {(r.zone, r.level) for r in g.zones.collect()} == {("tz:public", 0), ("tz:authenticated", 1), ("tz:admin", 2), ("tz:system", 3)}
    assert [r.service for r in g.services.collect()] == ["svc:shop"]
    assert {(r.ep, r.service) for r in g.belongs_to.collect()} == {(e, "svc:shop") for e in ("ep:POST:/login", "ep:GET:/admin/users", "ep:GET:/health")}
    assert {r.ep: r.zone for r in g.in_zone.collect()} == {"ep:POST:/login": "tz:public", "ep:GET:/admin/users": "tz:admin", "ep:GET:/health": "tz:public"}
    assert {r.name: (r.version, r.known_cves) for r in g.dependencies.collect()} == {"Werkzeug": ("2.0", ["CVE-1", "CVE-2"]), "Unused": ("", [])}
    found = {r.f: (r.type, r.title) for r in g.findings.collect()}
    assert found["find:config_analyzer:debug_mode_enabled:config.py:4"] == ("config", "Debug Mode Enabled")
    assert found["find:pip-audit:CVE-1:Werkzeug:0"] == ("dependency", "CVE-1 in Werkzeug") and not any("CVE-3" in f for f in found)
    assert {(r.f, r.fn) for r in g.affects.collect()} == {("find:bandit:B608:./db.py:3", "db.get_user"), ("find:builtin:missing-auth:app.py:13", "app.admin")}
    assert {r.label for r in build.nodes(g).collect()} == {"Function", "Endpoint", "DataStore", "Finding", "Service", "TrustZone", "Dependency"}


def test_chains_severities_and_score(spark, g):
    chains = {(r.rule, r.target_name) for r in rules.chain_edges(g).collect()}
    assert chains == {("sqli_pii", "users"), ("missing_auth_pii", "users")}
    counts = {r.rule: r.n for r in rules.chain_counts(g).collect()}
    assert counts["sqli_pii"] == 1 and counts["supply_chain"] > 0
    own = {r.f: r.contextual_severity for r in severity.contextual_severity(g).collect()}
    assert own["find:bandit:B608:./db.py:3"] == "CRITICAL" and own["find:bandit:B105:gone.py:1"] == "LOW"
    assert severity.scores(severity.rated(g)).first().score_exp < 100
    assert {r.measure: r.n for r in update.self_summary(g).collect()}["public endpoints"] == 3


def test_one_call_of_a_call(spark):
    facts = code.facts(sources(spark, m="def f():\n    return a(x()).b(y())\n"))
    assert sorted(r.name for r in facts.where("kind = 'call'").collect()) == ["a(x()).b", "y"]


def test_a_commit_replaces_its_files(spark, g):
    fixed = APP.replace('@app.route("/admin/users")', '@app.route("/admin/users")\n@login_required')
    changed = spark.createDataFrame([("app.py",), ("README.md",)], "path string")
    imports = spark.createDataFrame([("app.py", "db")], "path string, module string")
    rebuild = lambda paths: graph_of(spark, [], g.functions, app=fixed)
    commit = {"sha": "c1", "ts": "2026-01-01", "repo": "r"}
    after, diff, snaps = update.analyse(g, commit, changed, imports, rebuild)
    assert {r.fn for r in after.functions.collect()} == {"app.login", "app.admin", "app.health", "db.get_user", "db.list_users"}
    assert {(r.fn, r.ds) for r in after.access.collect()} == {("db.get_user", "ds:sqlite:users"), ("db.list_users", "ds:sqlite:users")}
    assert not any("/admin/users" in (r.description or "") for r in after.findings.where("rule_id = 'missing-auth'").collect())
    d = diff.first()
    assert d.delta < 0 and "IMPROVED" in d.summary
    again = update.analyse(g, commit, changed, imports, rebuild, snaps)[2]
    assert again.count() == 1 and again.first().counts["CRITICAL"] >= 1
    assert update.analyse(g, commit, spark.createDataFrame([("x.txt",)], "path string"), imports, rebuild) is None


def test_a_stream_goes_on_and_may_be_empty(spark, tmp_path):
    kind = "event_id long, ts timestamp, user_id long, event_type string"
    hours = lambda: {(r.repo, r.n) for r in events.run_once(events.hourly(spark.readStream.schema(kind).parquet(str(tmp_path / "in"))), str(tmp_path / "work")).collect()}
    (tmp_path / "in").mkdir()
    assert hours() == set()
    rows = spark.sql("select 1L as event_id, timestamp'2026-01-01 00:10:00' as ts, 1L as user_id, 'view' as event_type")
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert hours() == {("view", 1)}
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    assert hours() == {("view", 2)}


def test_bad_events_are_put_aside(spark):
    import hashlib
    import hmac

    body, secret = '{"a": 1}', "k" * 70
    sign = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(1, body, body, sign), (2, body, body, "sha256=00"), (3, "{", "{", None)], "id int, payload string, body string, signature string")
    good, bad = events.quarantined(rows, secret)
    assert [r.id for r in good.collect()] == [1] and {r.id: r.reason for r in bad.collect()} == {2: "bad signature", 3: "bad signature"}
    assert {r.id: r.reason for r in events.quarantined(rows)[1].collect()} == {3: "bad payload"}


def test_reviews_in_the_usual_format(spark):
    rows = [(1, "Done.\nRISK_LEVEL: HIGH\nTOP_ISSUES: SQLi, Missing auth\nREQUIRES_BLOCK: YES"), (2, "risk_level: critical\nrequires_block: no\ntop_issues: XSS"), (3, "nothing"), (4, None)]
    got = {r.id: (r.risk_level, r.requires_block, r.top_issues) for r in deliver.parse_review(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert got == {1: ("HIGH", True, ["SQLi", "Missing auth"]), 2: ("CRITICAL", False, ["XSS"]), 3: ("UNKNOWN", False, []), 4: ("UNKNOWN", False, [])}


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a|b")], "k int, v string")
    deliver.write_reports(rows, str(tmp_path), "Title")
    lines = [r.value for r in spark.read.text(str(tmp_path / "markdown")).collect()]
    assert lines[0] == "# Title" and lines[-1] == "| 1 | a b |" and spark.read.json(str(tmp_path / "json")).count() == 1


def test_remediation_prompt(spark):
    row = spark.createDataFrame([(1, "CWE-89", None, "f", "", "bind")], "f int, cwe_id string, severity string, function string, endpoints string, advice string")
    text = deliver.remediation_prompt(row).first().prompt
    assert "Weakness: CWE-89" in text and "Severity: unknown" in text and "Guidance: bind" in text


def test_knowledge_is_loaded_once_and_routed(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return knowledge.owasp_documents(knowledge.owasp(spark))

    docs = knowledge.load(spark, str(tmp_path / "k"), make)
    assert knowledge.load(spark, str(tmp_path / "k"), make).count() == docs.count() == 10 and len(made) == 1
    docs = knowledge.load(spark, str(tmp_path / "k"), make, force=True)
    assert docs.count() == 10 and len(made) == 2
    cwe = spark.createDataFrame([("CWE-89", "CWE-89: SQL text", {"source": "cwe"})], "id string, document string, metadata map<string,string>")
    asked = spark.createDataFrame([(1, " cwe-89 "), (2, "server-side request forgery"), (3, "89")], "query_id int, text string")
    got = {r.query_id: (r.id, r.score) for r in knowledge.routed(asked, docs.unionByName(cwe), k=1).collect()}
    assert got[1] == got[3] == ("CWE-89", 1.0) and got[2][0] == "A10:2021"
    assert knowledge.routed(asked, docs, k=99, sources=("none",)).count() == 0
    new = knowledge.store(docs, cwe.unionByName(docs.where("id = 'A01:2021'").selectExpr("id", "'new' as document", "metadata")))
    assert new.count() == 11 and new.where("document = 'new'").count() == 1


def test_weaknesses_in_full(spark, tmp_path):
    p = tmp_path / "w.xml"
    p.write_text(
        '<C><Weakness ID="89" Name="SQL" Abstraction="Base" Status="Stable" Likelihood_Of_Exploit="High"><Description>d</Description><Related_Weaknesses><Related_Weakness CWE_ID="74"/><Related_Weakness CWE_ID="20"/></Related_Weaknesses>'
        "<Common_Consequences><Consequence><Scope>Integrity</Scope><Impact>Modify</Impact></Consequence></Common_Consequences>"
        "<Potential_Mitigations><Mitigation><Phase>Design</Phase><Description>bind</Description></Mitigation><Mitigation><Description>check</Description></Mitigation></Potential_Mitigations></Weakness></C>"
    )
    r = reports.read_weaknesses(spark, str(p))
    d = knowledge.cwe_documents(r).first()
    assert d.document == "CWE-89: SQL\nAbstraction: Base\nDescription: d\nConsequences: Integrity: Modify\nMitigations: [Design] bind; check\nLikelihood: High"
    assert d.metadata["related_cwe_ids"] == "74,20"


def test_feed_versions_of_the_package(spark):
    import json

    page = {"vulnerabilities": [{"cve": {"id": "C", "configurations": [{"nodes": [{"cpeMatch": [{"criteria": "cpe:flask:x", "versionEndIncluding": "2.0"}, {"criteria": "cpe:other", "versionEndIncluding": "9"}, {"criteria": "cpe:Flask", "versionEndExcluding": "1.1"}]}]}]}}]}
    rows = spark.createDataFrame([(json.dumps(page), "flask")], "value string, package string")
    r = reports.parse_vulnerability_feed(rows)
    assert r.first().affected == ["<= 2.0", "<= 1.1"]
    assert knowledge.cve_documents(r.union(r)).first().document.endswith("Affected versions: <= 2.0; <= 1.1") and knowledge.cve_documents(r.union(r)).count() == 1


def test_known_findings_and_chains(spark, g):
    own = severity.contextual_severity(g).select("f", "contextual_severity").join(g.findings.select("f", "cwe_id", "file", "title", "raw_severity"), "f")
    results = evaluate.engine(own, evaluate.known_findings(spark))
    assert {r.gid: r.detected for r in results.collect()} == {"F1": True, "F2": True, "F3": False, "F4": True, "F5": True, "F6": False}
    edges = rules.chain_edges(g).selectExpr("concat(evidence, ' ', rule) as text")
    r = evaluate.rates(results, evaluate.chains_found(edges, evaluate.known_chains(spark))).first()
    assert r.total == 6 and r.detected == 4 and r.chains == 2
    scans = spark.createDataFrame([("B608", "LOW", 2), ("B608", "HIGH", 1), ("B106", "LOW", 3)], "rule_id string, severity string, seq int")
    got = {r.gid: (r.severity, r.underrated) for r in evaluate.scanner(scans, evaluate.known_findings(spark)).where("detected").collect()}
    assert got == {"F1": ("HIGH", False), "F4": ("LOW", True)}
    rated = spark.createDataFrame([("LOW", "HIGH", "HIGH"), ("LOW", "LOW", "HIGH"), ("LOW", "HIGH", "LOW")], "raw string, truth string, guess string")
    u = match.upgrades(rated).first()
    assert (u.correct, u.upgrade_precision, u.upgrade_recall) == (1, 0.5, 0.5)


def test_documents_without_a_word_fill_the_list(spark):
    from rampart.operators import retrieval

    docs = spark.createDataFrame([(i, "common word" if i == 3 else f"other{i}") for i in range(8)], "id int, text string")
    asked = spark.createDataFrame([(1, "common"), (2, "nowhere"), (3, None)], "query_id int, text string")
    got = {}
    for r in retrieval.bm25(docs, asked, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score > 0))
    assert sorted(got[1]) == [(1, 3, True), (2, 0, False), (3, 1, False)]
    assert sorted(got[2]) == sorted(got[3]) == [(1, 0, False), (2, 1, False), (3, 2, False)]
