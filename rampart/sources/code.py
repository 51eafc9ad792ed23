"""Facts from Python source texts: functions, calls, imports, endpoints, store accesses, taint flows.

`facts` parses each file once, in Arrow batches, and returns one row for each fact; the typed relations are filters of
it. Who reads it more than once writes it first, else files are parsed for each reader. A file that can't be parsed gives
one `error` row and doesn't stop the job.
"""

from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Calls that touch stores: receiver, method, kind of store, access.
STORES = (
    (r"cursor|conn|connection", r"^execute$", "sqlite", "read"),
    (r"cursor|conn|connection", r"^executemany$", "sqlite", "write"),
    (r"session|db", r"^(query|get|first|all|one)$", "sqlalchemy", "read"),
    (r"session|db", r"^(add|merge|flush|commit)$", "sqlalchemy", "write"),
    (r"session|db", r"^(delete|remove)$", "sqlalchemy", "write"),
    (r"redis|cache|r\b", r"^(get|hget|lrange|smembers|zrange|mget)$", "redis", "read"),
    (r"redis|cache|r\b", r"^(set|hset|lpush|rpush|sadd|zadd|mset|delete|expire)$", "redis", "write"),
    (r".*", r"^open$", "filesystem", "read"),
)
#: Calls that tainted values must not reach, by kind; the first that fits counts.
SINKS = (
    (r"(?i)\bcursor\.execute|conn\.execute|connection\.execute|session\.execute\b", "sql_injection"),
    (r"\bsubprocess\.(run|Popen|call|check_output|check_call)\b", "command_injection"),
    (r"\bos\.(system|popen)\b", "command_injection"),
    (r"^eval$", "code_eval"),
    (r"^exec$", "code_eval"),
    (r"^open$", "path_traversal"),
    (r"(?i)\brequests\.(get|post|put|delete|patch|request|head)\b", "ssrf"),
    (r"(?i)\burllib\.(request\.)?urlopen\b|\burllib2\.urlopen\b", "ssrf"),
    (r"(?i)\bhttpx\.(get|post|put|delete|patch|request)\b", "ssrf"),
)
#: What brings request data in, and what cleans it.
_REQUEST_PARTS = frozenset(("args", "form", "json", "data", "values", "files", "get_json"))
REQUEST = re.compile(r"request\.(args|form|json|data|values|files|get_json)\b", re.I)
CLEANERS = re.compile(
    r"\b(escape|sanitize|quote|bleach\.clean|html\.escape|markupsafe|re\.escape|urllib\.parse\.quote|validators\.validate|filter|strip_tags|html\.unescape|parameterize)\b",
    re.I,
)
#: Decorators and parameters that mean authentication.
AUTH = re.compile(
    r"login_required|auth_required|require_auth|requires_auth|admin_only|permission_required|protect|authenticated|jwt_required|token_required",
    re.I,
)
DEPENDS = re.compile(r"Depends\s*\(\s*(get_current_user|verify_token|authenticate|oauth2_scheme|security)", re.I)
VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
FIELDS = ("file", "kind", "name", "qualified", "line", "end_line", "items", "target", "detail", "flag")
SCHEMA = "file string, kind string, name string, qualified string, line int, end_line int, items array<string>, target string, detail string, flag boolean"


#: What texts of calls must hold for any of STORES or SINKS to fit, so that most calls are looked at once.
_ANY_STORE = re.compile("|".join(what for _, what, _, _ in STORES), re.I)
_ANY_SINK = re.compile("|".join(p.replace("(?i)", "") for p, _ in SINKS), re.I)
_STORES = tuple((re.compile(who, re.I), re.compile(what, re.I), kind, access) for who, what, kind, access in STORES)
_SINKS = tuple((re.compile(p), kind) for p, kind in SINKS)
_INNER = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)
_HELD = (ast.stmt, ast.excepthandler, ast.match_case)


def _children(node: ast.AST) -> list[ast.AST]:
    """A node's children in order, without marks of loading and storing."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST) and not isinstance(value, ast.expr_context):
            out.append(value)
    return out


def _own_nodes(body: list) -> list[ast.AST]:
    """Nodes of statements, parents first, without those of functions and classes defined within."""
    out, left = [], body[::-1]
    while left:
        node = left.pop()
        if not isinstance(node, _INNER):
            out.append(node)
            left += _children(node)[::-1]
    return out


def _calls(body: list) -> list[ast.Call]:
    """Calls of statements or expressions, outer ones first; the expression that is called isn't looked into."""
    out, left = [], body[::-1]
    while left:
        node = left.pop()
        if isinstance(node, ast.Call):
            out.append(node)
            left += [*node.args, *node.keywords][::-1]
        elif not isinstance(node, _INNER):
            left += _children(node)[::-1]
    return out


def _imports(tree: ast.Module) -> Iterator[ast.AST]:
    """Import statements, outer ones first: only statements hold them."""
    level = [tree]
    while level:
        yield from (n for n in level if isinstance(n, (ast.Import, ast.ImportFrom)))
        level = [c for n in level for name in n._fields if isinstance(v := getattr(n, name, None), list) for c in v if isinstance(c, _HELD)]


def _text(node: ast.AST) -> str:
    """The text of an expression; most that are called are names with dots."""
    parts, at = [], node
    while isinstance(at, ast.Attribute):
        parts.append(at.attr)
        at = at.value
    return ".".join([at.id, *parts[::-1]]) if isinstance(at, ast.Name) else ast.unparse(node)


def _is_request(node: ast.AST) -> bool:
    """Whether an attribute is one of a request's parts, as REQUEST says of its text."""
    owner = getattr(node, "value", None)
    name = owner.id if isinstance(owner, ast.Name) else owner.attr if isinstance(owner, ast.Attribute) else ""
    return isinstance(node, ast.Attribute) and node.attr.lower() in _REQUEST_PARTS and name.lower().endswith("request")


def auth_type(decorator: str) -> str:
    """The kind of authentication that a decorator's text means."""
    text = decorator.lower()
    kinds = (("jwt", "jwt"), ("token", "jwt"), ("session", "session"), ("login", "session"), ("api_key", "api_key"), ("basic", "basic"))
    return next((kind for word, kind in kinds if word in text), "session")


#: Kinds that come along with others.
_WITH = {"function": ("returns",), "endpoint": ("framework",), "call": ("access",)}


class _File:
    """The facts of one file, in order of place, as tuples of FIELDS; of some kinds alone, if they are given."""

    def __init__(self, path: str, text: str, kinds: frozenset[str] | None = None):
        self.path, self.rows, self.kinds = path, [], kinds
        self.module = re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")
        self.known: dict[str, str] = {}
        self.imports: dict[str, str] = {}
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError) as e:
            self.add("error", detail=str(e)[:200])
            return
        packages = set()
        for node in _imports(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    packages.add(a.name.split(".")[0])
                    self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif node.module:
                packages.add(node.module.split(".")[0])
                self.imports |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
        self.add("imports", items=sorted(packages))
        self.walk(tree.body, "")

    def wants(self, *kinds: str) -> bool:
        return self.kinds is None or not self.kinds.isdisjoint(kinds)

    def add(self, kind: str, node: ast.AST | None = None, name=None, qualified=None, items=None, target=None, detail=None, flag=None) -> None:
        if self.wants(kind):
            self.rows.append((self.path, kind, name, qualified, getattr(node, "lineno", None), getattr(node, "end_lineno", None), items, target, detail, flag))

    def walk(self, body, owner: str) -> None:
        for node in body:
            if isinstance(node, ast.ClassDef):
                self.walk(node.body, node.name)
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(node, owner)
                self.walk(node.body, owner)

    def function(self, node, owner: str) -> None:
        qualified = ".".join(filter(None, (self.module, owner, node.name)))
        self.known[f"{owner}.{node.name}" if owner else node.name] = qualified
        params = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.arg not in ("self", "cls")]
        decorators = [ast.unparse(d) for d in node.decorator_list] if self.wants("function", "endpoint", "framework") else []
        own = _own_nodes(node.body) if self.wants("function", "taint") else []
        sources = any(map(_is_request, own))
        self.add("function", node, name=node.name, qualified=qualified, items=params, detail="; ".join(decorators), flag=sources, target=ast.get_docstring(node))
        if node.returns is not None:
            self.add("returns", node, name=node.name, qualified=qualified, detail=ast.unparse(node.returns))
        if self.wants("endpoint", "framework"):
            for d in node.decorator_list:
                self.endpoint(d, node, qualified, params, decorators)
        if self.wants("call", "access"):
            for call in _calls(node.body):
                self.call(call, qualified, owner)
        if self.wants("taint"):
            self.taint(own, qualified, params)

    def endpoint(self, d, node, qualified: str, params: list[str], decorators: list[str]) -> None:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str)):
            return
        verb, path = d.func.attr, d.args[0].value
        if verb not in ("route", *VERBS):
            return
        listed = next((k.value for k in d.keywords if k.arg == "methods"), None)
        methods = [ast.literal_eval(x) for x in listed.elts if isinstance(x, ast.Constant)] if isinstance(listed, (ast.List, ast.Tuple)) else ["GET"]
        methods = [m.upper() for m in (methods if verb == "route" else [verb])]
        guards, signature = " ".join(decorators), ast.unparse(node.args)
        auth = "jwt" if DEPENDS.search(f"{guards} {signature}") or "current_user" in signature or "token:" in signature else None
        if hit := next((d for d in decorators if AUTH.search(d)), None):
            auth = auth_type(hit)
        inputs = [*re.findall(r"<(?:\w+:)?(\w+)>", path), *re.findall(r"\{(\w+)\}", path), *params]
        for method in methods:
            self.add("endpoint", node, name=path, qualified=qualified, target=method, items=list(dict.fromkeys(inputs)), detail=auth or "none", flag=auth is not None)
            self.add("framework", node, name=path, qualified=qualified, target=method, detail="fastapi" if "router" in _text(d.func).split(".")[0].lower() else "flask")

    def call(self, call: ast.Call, caller: str, owner: str) -> None:
        raw = _text(call.func)
        head, _, rest = raw.partition(".")
        if head == "self" and owner:
            to = self.known.get(f"{owner}.{rest}")
        else:
            to = self.known.get(raw) or (f"{self.module}.{owner}.{raw}" if f"{owner}.{raw}" in self.known else None)
            if not to and head in self.imports:
                to = self.imports[head] + (f".{rest}" if rest else "")
        self.add("call", call, name=raw, qualified=caller, target=to or f"unresolved.{raw}", flag=to is not None)
        receiver, _, method = raw.rpartition(".")
        if raw == "open":
            file = next((a.value for a in call.args if isinstance(a, ast.Constant) and isinstance(a.value, str)), "file")
            self.add("access", call, name="filesystem", qualified=caller, target="read", detail=None, items=[file])
        for who, what, kind, access in _STORES if receiver and _ANY_STORE.match(method) else ():
            if who.search(receiver) and what.match(method):
                texts = [x for a in call.args for x in ast.walk(a) if isinstance(x, ast.Constant) and isinstance(x.value, str)]
                sql = min(texts, key=lambda x: (x.lineno, x.col_offset)).value if texts else None  # the first as it is written
                self.add("access", call, name=kind, qualified=caller, target=access, detail=sql)
                break

    def taint(self, own: list[ast.AST], qualified: str, params: list[str]) -> None:
        """Statements in order: values of tainted names taint what they are assigned to, unless a cleaner is applied."""
        tainted = {p: (p, "function_param") for p in params}
        for n in (x for x in own if isinstance(x, (ast.Assign, ast.AugAssign, ast.Call))):
            if isinstance(n, ast.Call):
                self.sink(n, qualified, tainted)
                continue
            text = ast.unparse(n.value) if isinstance(n, ast.Assign) else ""
            used = sorted(x.id for x in ast.walk(n.value) if isinstance(x, ast.Name) and x.id in tainted)
            for t in (x.id for target in (n.targets if isinstance(n, ast.Assign) else [n.target]) for x in ast.walk(target) if isinstance(x, ast.Name)):
                if isinstance(n, ast.Assign) and REQUEST.search(text):
                    tainted[t] = (t, "request_param")
                elif used and isinstance(n, ast.Assign) and CLEANERS.search(text):
                    tainted.pop(t, None)
                elif used:
                    tainted[t] = tainted[used[0]]

    def sink(self, call: ast.Call, qualified: str, tainted: dict) -> None:
        raw = _text(call.func)
        kind = next((k for p, k in _SINKS if p.search(raw)), None) if _ANY_SINK.search(raw) else None
        if not kind:
            return
        args = [*call.args, *(k.value for k in call.keywords)]
        names = sorted(x.id for a in args for x in ast.walk(a) if isinstance(x, ast.Name) and x.id in tainted)
        if names:
            source, source_kind = tainted[names[0]]
            clean = bool(CLEANERS.search(" ".join(map(ast.unparse, args))))
            self.add("taint", call, name=kind, qualified=qualified, target=source, detail=source_kind, flag=clean)


#: Facts that a Python worker holds at a time, and those of the file that passes them.
HELD = 5_000


def parsed(batches: Iterable[pa.RecordBatch], kinds: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of about HELD facts of batches of files, however many files one has."""
    text_, list_ = pa.string(), pa.list_(pa.string())
    types = (text_, text_, text_, text_, pa.int32(), pa.int32(), list_, text_, text_, pa.bool_())
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)], names=list(FIELDS))
    rows = []
    for batch in batches:
        path, text = batch.column("path"), batch.column("text")
        for i in range(batch.num_rows):
            rows += _File(path[i].as_py() or "", text[i].as_py() or "", kinds).rows
            if len(rows) >= HELD:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def facts(files: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """All facts of files(path, text), or those of some kinds and of kinds that come along with them: others aren't looked for."""
    some = None if kinds is None else frozenset(x for k in kinds for x in (k, *_WITH.get(k, ())))
    own = files.select("path", "text")
    return own.repartition(_tasks(own), "path").mapInArrow(lambda batches: parsed(batches, some), SCHEMA)


def _tasks(df: DataFrame, task_bytes: int = 16 << 20) -> int:
    """How many tasks parse df: at least as many as there are cores, as texts compress well and parsing costs far more than reading.

    The number is given, as adaptive execution would bring small partitions together into one task. Where the plan's size
    isn't known, it is that of shuffles.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = -(-size // task_bytes) if size < 1 << 50 else int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(100_000, max(spark.sparkContext.defaultParallelism, by_size))


def functions(all_: DataFrame) -> DataFrame:
    """Functions with what they return and say of themselves, whether a route decorator makes them entries, and whether they handle input."""
    own = all_.where("kind = 'function'").select(
        "file", "name", "qualified", "line", "end_line", F.col("items").alias("params"), F.col("detail").alias("decorators"), F.col("flag").alias("has_request"), F.col("target").alias("docstring")
    )
    returns = all_.where("kind = 'returns'").groupBy("file", "qualified", "line").agg(F.max("detail").alias("returns"))
    own = own.join(returns, ["file", "qualified", "line"], "left")
    entry = F.col("decorators").rlike("(route|get|post|put|delete|patch)")
    return own.withColumns({"is_entry": entry, "handles_input": entry | (F.size("params") > 0)})


def list_files(root: str, suffix: str = ".py") -> list[str]:
    """Paths under root, hidden and underscored names included, which Spark's file sources would leave out."""
    skip = {".git", ".venv", "venv", "node_modules", "__pycache__", "build", "dist"}
    out = []
    for d, dirs, names in os.walk(root):
        dirs[:] = sorted(x for x in dirs if x not in skip)
        out += [os.path.join(d, n) for n in sorted(names) if n.endswith(suffix)]
    return out


def texts_of(spark: SparkSession, root: str, found: list[str]) -> DataFrame:
    """path (below root), text of files that all executors can read; only their paths pass through the driver."""
    paths = spark.createDataFrame([(os.path.relpath(p, root), p) for p in found], "path string, at string")

    def run(batches):
        for batch in batches:
            texts = []
            for at in batch.column("at").to_pylist():
                with open(at, encoding="utf-8", errors="replace") as f:
                    texts.append(f.read())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], names=["path", "text"])

    return paths.mapInArrow(run, "path string, text string")


def read_files(spark: SparkSession, root: str, suffix: str = ".py") -> DataFrame:
    """path, text of the source files below a folder."""
    return texts_of(spark, root, list_files(root, suffix))
