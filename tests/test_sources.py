"""Source parsing and reports, on a small application of our own."""

import json

import pytest

from rampart.operators import build
from rampart.sources import code, reports

APP = '''
import os, requests as rq
from flask import Flask, request
from store import find_user
app = Flask(__name__)

@app.route("/login", methods=["POST"])
def login():
    name = request.form["name"]
    return find_user(name)

@app.get("/items/{item_id}")
@login_required
def items(item_id):
    return render(item_id)

@app.route("/admin/list")
def listing():
    return helper()

def helper():
    raw = request.args.get("p")
    path = escape(raw)
    eval(raw)
    return open(path)
'''
STORE = '''
class Users:
    def find(self, name):
        return self.run(name)

    def run(self, name):
        q = name
        conn.execute("SELECT * FROM users WHERE n = ?", q)
        session.delete(q)

def find_user(name):
    cursor.execute("INSERT INTO cards VALUES (1)")
'''


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("app.py", APP), ("store.py", STORE), ("bad.py", "def ("), ("pkg/__init__.py", "def f(): pass"), ("none.py", None)], "path string, text string")
    return code.facts(files).cache()


def test_functions(facts):
    got = {r.qualified: r for r in build.function_nodes(facts).collect()}
    assert set(got) == {"app.login", "app.items", "app.listing", "app.helper", "store.Users.find", "store.Users.run", "store.find_user", "pkg.f"}
    assert got["app.login"].is_entry and got["app.login"].has_request and not got["app.helper"].is_entry
    assert got["store.Users.find"].params == ["name"]


def test_broken_files_give_an_error_row(facts):
    assert [r.file for r in facts.where("kind = 'error'").collect()] == ["bad.py"]


def test_calls_resolve_by_place_class_and_import(facts):
    edges, lost = build.call_edges(facts)
    got = {(r.src, r.dst) for r in edges.collect()}
    assert ("app.login", "store.find_user") in got
    assert ("app.listing", "unresolved.helper") in got  # defined below
    assert ("store.Users.find", "unresolved.self.run") in got
    assert "unresolved.render" in {r.qualified for r in lost.collect()}


def test_endpoints_and_missing_auth(facts):
    e = build.endpoint_nodes(facts)
    got = {(r.method, r.path): (r.is_public, r.zone, r.auth_type) for r in e.collect()}
    assert got == {("POST", "/login"): (True, "public", "none"), ("GET", "/items/{item_id}"): (False, "public", "session"), ("GET", "/admin/list"): (True, "admin", "none")}
    assert [r.path for r in build.missing_auth(e).collect()] == ["/admin/list"]


def test_stores(facts):
    got = {(r.fn, r.store, r.pii, r.edge) for r in build.store_edges(facts).collect()}
    assert got == {("store.Users.run", "users", True, "READS_FROM"), ("store.Users.run", "sqlalchemy", False, "WRITES_TO"), ("store.find_user", "cards", True, "WRITES_TO"), ("app.helper", "file", False, "READS_FROM")}


def test_taint_follows_assignments_and_cleaners(facts):
    got = {r.fn: (r.sinks, r.sources) for r in build.taint_marks(facts).collect()}
    assert got == {"store.Users.run": (["sql_injection"], ["name"]), "app.helper": (["code_eval"], ["raw"])}


def test_uses(spark, facts):
    wanted = spark.createDataFrame([("Flask",), ("Requests",), ("numpy",)], "name string")
    got = {(r.fn, r.dep) for r in build.dependency_edges(facts, wanted).collect()}
    assert ("app.login", "Flask") in got and ("app.login", "Requests") in got and len({d for _, d in got}) == 2


def test_hidden_files_are_read(spark, tmp_path):
    (tmp_path / "__init__.py").write_text("x = 1")
    (tmp_path / ".env.py").write_text("y = 2")
    assert {r.path for r in code.read_files(spark, str(tmp_path)).collect()} == {"__init__.py", ".env.py"}


def test_requirements(spark, tmp_path):
    p = tmp_path / "requirements.txt"
    p.write_text("# c\nFlask==2.0\nrequests >= 2.1  # why\n\n-r other.txt\nnumpy\n")
    got = {r.name: (r.version, r.pinned) for r in reports.read_requirements(spark, str(p)).collect()}
    assert got == {"Flask": ("2.0", True), "requests": ("2.1", False), "numpy": (None, False)}


def test_reports(spark):
    def rows(*docs):
        return spark.createDataFrame([(d if isinstance(d, str) else json.dumps(d),) for d in docs], "value string")

    one = {"check_id": "r", "path": "a.py", "start": {"line": 3}, "extra": {"severity": "ERROR", "message": "m", "metadata": {"cwe": ["CWE-89: x"]}}}
    two = {"check_id": "r", "path": "a.py", "start": {"line": 4}, "extra": {"severity": "odd", "message": "m", "metadata": {"cwe": "CWE-79"}}}
    got = [(r.severity, r.cwe_id, r.line) for r in reports.parse_semgrep(rows({"results": [one, two]}, "broken")).collect()]
    assert got == [("CRITICAL", "CWE-89", 3), ("INFO", "CWE-79", 4)]
    b = {"issue_severity": "high", "issue_cwe": {"id": 89}, "filename": "a.py", "test_id": "B608", "issue_text": "t", "line_number": 5}
    assert [(r.severity, r.cwe_id) for r in reports.parse_bandit(rows({"results": [b]})).collect()] == [("HIGH", "CWE-89")]
    a = {"dependencies": [{"name": "x", "version": "1", "vulns": [{"id": "C1", "fix_versions": []}, {"id": "C2", "fix_versions": ["2", "3"], "severity": "LOW"}]}, {"name": "y", "version": "1", "vulns": []}]}
    assert [(r.cve_id, r.fixed, r.severity) for r in reports.parse_audit(rows(a)).collect()] == [("C1", None, "HIGH"), ("C2", "2", "LOW")]
    v = {"vulnerabilities": [{"cve": {"id": "C", "published": "2024-01-02T00", "descriptions": [{"lang": "es", "value": "n"}, {"lang": "en", "value": "d"}], "metrics": {"cvssMetricV2": [{"cvssData": {"baseScore": 5.0}}], "cvssMetricV31": [{"cvssData": {"baseScore": 9.8, "baseSeverity": "CRITICAL"}}]}}}]}
    r = reports.parse_vulnerability_feed(rows(v)).first()
    assert (r.cve_id, r.score, r.severity, r.published, r.description) == ("C", 9.8, "CRITICAL", "2024-01-02", "d")


def test_weaknesses(spark, tmp_path):
    p = tmp_path / "w.xml"
    p.write_text('<Catalog><Weaknesses><Weakness ID="89" Name="SQL"><Description>d</Description></Weakness></Weaknesses></Catalog>')
    r = reports.read_weaknesses(spark, str(p)).first()
    assert (r.id, r.name, r.description) == ("CWE-89", "SQL", "d")


def test_configuration(spark, tmp_path):
    from rampart.sources import config

    (tmp_path / "app").mkdir()
    (tmp_path / "venv").mkdir()
    (tmp_path / "venv" / "x.py").write_text('token = "0123456789"')
    (tmp_path / "app" / "c.py").write_text('A = 1\nSECRET_KEY = "abcdefgh"\nx = os.environ["SECRET_KEY"]\nDEBUG = True\nallow_origins=["*"] ; password = "abcde"\n')
    (tmp_path / ".env").write_text("API_KEY=abcdef\nTOKEN=$OTHER\nNAME=abcdef\nDB_PASSWORD=abc\n")
    (tmp_path / "notes.md").write_text('token = "0123456789"')
    got = sorted((r.path, r.n, r.kind, r.severity) for r in config.config_issues(config.read_config(spark, str(tmp_path))).collect())
    assert got == [
        (".env", 1, "hardcoded_secret", "HIGH"),
        ("app/c.py", 2, "hardcoded_secret", "HIGH"),
        ("app/c.py", 4, "debug_mode_enabled", "MEDIUM"),
        ("app/c.py", 5, "cors", "MEDIUM"),
        ("app/c.py", 5, "hardcoded_password", "HIGH"),
    ]


def test_analyse(spark, tmp_path):
    from rampart.__main__ import analyse

    (tmp_path / "app.py").write_text(APP)
    out = analyse(spark, str(tmp_path))
    assert [r.path for r in out["missing authentication"].collect()] == ["/admin/list"]
    assert out["endpoints"].count() == 3 and out["unreadable"].count() == 0
