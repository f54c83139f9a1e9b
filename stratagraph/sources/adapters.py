"""Extraction: files to entities and facts, by adapters.

An adapter takes (path, text) and yields rows (kind, name, relation, target,
line).  Adapters run inside one pass over the files; a file that breaks an
adapter gives an error row and doesn't stop the others.  What needs more than a
file, such as selectors, is left to joins over the rows.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Row = tuple[str, str, str, str, int]
Adapter = Callable[[str, str], Iterator[Row]]

#: Adapter name -> (patterns of file names, the relations that it may emit, function).
ADAPTERS: dict[str, tuple[tuple[str, ...], frozenset[str], Adapter]] = {}


def adapter(name: str, patterns: str, relations: str) -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        if name in ADAPTERS:
            raise ValueError(f"adapter {name} exists")
        ADAPTERS[name] = (tuple(patterns.split()), frozenset(relations.split()), f)
        return f

    return add


def numbered(text: str) -> Iterator[tuple[int, str]]:
    return enumerate(text.splitlines(), 1)


def _yaml(text: str) -> list:
    import yaml

    return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]


_ASSIGNED = re.compile(r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*)$")


def dotenv_value(raw: str) -> str:
    """A value without its quotes and, unless quoted, without a trailing comment."""
    raw = raw.strip()
    if raw[:1] in ("'", '"'):
        end = raw.find(raw[0], 1)
        return raw[1:end] if end > 0 else raw[1:]
    return re.split(r"\s+#", raw, maxsplit=1)[0].strip()


@adapter("config-dotenv", ".env .env.* *.env", "REFERENCES_ENV_VAR")
def dotenv(path: str, text: str) -> Iterator[Row]:
    for n, line in numbered(text):
        if not line.lstrip().startswith("#") and (m := _ASSIGNED.match(line)):
            yield "EnvVar", m[1], "REFERENCES_ENV_VAR", "set" if dotenv_value(m[2]) else "empty", n


_DOMAIN = re.compile(r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,24}\b")


@adapter("config-cname", "CNAME", "REFERENCES_DOMAIN")
def cname(path: str, text: str) -> Iterator[Row]:
    for n, line in numbered(text):
        if _DOMAIN.fullmatch(line.strip().lower()):
            yield "Domain", line.strip().lower(), "REFERENCES_DOMAIN", path, n


_URL = re.compile(r"\b(?:https?|wss?)://([A-Za-z0-9.-]+)")
_ENV_READ = re.compile(r"(?:os\.environ(?:\.get)?[\[(]|os\.getenv\(|process\.env\.|process\.env\[|\$\{)\s*['\"]?([A-Z][A-Z0-9_]+)")


@adapter("config-domain-env", "*.py *.ts *.js *.yml *.yaml *.json *.toml *.ini *.cfg *.conf", "REFERENCES_DOMAIN REFERENCES_ENV_VAR")
def domain_env(path: str, text: str) -> Iterator[Row]:
    for n, line in numbered(text):
        for host in _URL.findall(line):
            if _DOMAIN.fullmatch(host.lower()):
                yield "Domain", host.lower(), "REFERENCES_DOMAIN", path, n
        for name in _ENV_READ.findall(line):
            yield "EnvVar", name, "REFERENCES_ENV_VAR", path, n


_METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


@adapter("config-openapi", "openapi.* swagger.*", "DOCUMENTS_ENDPOINT")
def openapi(path: str, text: str) -> Iterator[Row]:
    for doc in [json.loads(text)] if path.endswith(".json") else _yaml(text):
        for route, item in (doc.get("paths") or {}).items():
            for method in _METHODS:
                if isinstance(item, dict) and method in item:
                    yield "Endpoint", f"{method.upper()} {route}", "DOCUMENTS_ENDPOINT", path, 1


@adapter("config-grpc-proto", "*.proto", "EXPOSES_ENDPOINT")
def grpc(path: str, text: str) -> Iterator[Row]:
    package, service = "", ""
    bare = re.sub(r"/\*.*?\*/", lambda m: "\n" * m[0].count("\n"), text, flags=re.S)
    for n, line in numbered(bare):
        line = line.split("//")[0]
        if m := re.match(r"\s*package\s+([\w.]+)\s*;", line):
            package = m[1] + "."
        if m := re.search(r"\bservice\s+(\w+)", line):
            service = m[1]
        if (m := re.search(r"\brpc\s+(\w+)\s*\(", line)) and service:
            yield "Endpoint", f"POST /{package}{service}/{m[1]}", "EXPOSES_ENDPOINT", f"{package}{service}", n


_WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Pod")


@adapter("config-kubernetes-yaml", "*.yaml *.yml", "DEPLOYS_VIA_CONFIG HAS_LABEL SELECTS ROUTES_DOMAIN_TO_DEPLOY")
def kubernetes(path: str, text: str) -> Iterator[Row]:
    if "apiVersion" not in text:
        return
    for doc in _yaml(text):
        kind, meta, spec = doc.get("kind", ""), doc.get("metadata") or {}, doc.get("spec") or {}
        name = f"{meta.get('namespace', 'default')}/{meta.get('name', '')}"
        if kind in _WORKLOADS and not meta.get("ownerReferences"):
            yield "DeployTarget", name, "DEPLOYS_VIA_CONFIG", kind, 1
            inner = spec.get("jobTemplate", {}).get("spec", {}) if kind == "CronJob" else spec
            labels = (inner.get("template") or {}).get("metadata", {}).get("labels") or (meta.get("labels") if kind == "Pod" else None)
            for k, v in (labels or {}).items():
                yield "DeployTarget", name, "HAS_LABEL", f"{k}={v}", 1
        elif kind == "Service":
            for k, v in (spec.get("selector") or {}).items():
                yield "Service", name, "SELECTS", f"{k}={v}", 1
        elif kind == "Ingress":
            for rule in spec.get("rules") or []:
                for p in ((rule.get("http") or {}).get("paths")) or []:
                    backend = p.get("backend") or {}
                    service = (backend.get("service") or {}).get("name") or backend.get("serviceName")
                    if rule.get("host") and service:
                        yield "Domain", rule["host"].lower(), "ROUTES_DOMAIN_TO_DEPLOY", f"{name.split('/')[0]}/{service}", 1


@adapter("config-serverless-yaml", "serverless.yml serverless.yaml", "EXPOSES_ENDPOINT CONSUMES_EVENT")
def serverless(path: str, text: str) -> Iterator[Row]:
    for doc in _yaml(text):
        for name, function in (doc.get("functions") or {}).items():
            for event in (function or {}).get("events") or []:
                if not isinstance(event, dict):
                    continue
                for source, what in event.items():
                    if source in ("http", "httpApi"):
                        method, route = (str(what).split(" ", 1) + [""])[:2] if isinstance(what, str) else (what.get("method", "*"), what.get("path", ""))
                        yield "Endpoint", f"{'ANY' if method in ('*', 'any') else method.upper()} /{route.lstrip('/')}", "EXPOSES_ENDPOINT", name, 1
                    elif source in ("sqs", "sns", "stream", "eventBridge"):
                        arn = what if isinstance(what, str) else what.get("arn") or what.get("topicName") or what.get("eventBus") or ""
                        yield "EventChannel", f"{source}:{str(arn).rsplit(':', 1)[-1]}", "CONSUMES_EVENT", name, 1


@adapter("config-terraform", "*.tf", "REFERENCES_DOMAIN DEFINES_CHANNEL CONSUMES_EVENT")
def terraform(path: str, text: str) -> Iterator[Row]:
    block, depth, heredoc = None, 0, ""
    for n, raw in numbered(text):
        if heredoc:
            heredoc = "" if raw.strip() == heredoc else heredoc
            continue
        line = re.split(r"(?:^|\s)(?:#|//)", raw)[0]
        if m := re.search(r"<<-?\s*(\w+)\s*$", line):
            heredoc = m[1]
        if depth == 0 and (m := re.match(r'\s*resource\s+"([^"]+)"\s+"([^"]+)"', line)):
            block = (m[1], m[2])
        if block and (m := re.match(r'\s*(\w+)\s*=\s*(?:"([^"$]*)"|([\w.\[\]"]+))\s*$', line)):
            key, literal, reference = m.groups()
            if block[0] in ("aws_sqs_queue", "aws_sns_topic") and key == "name" and literal:
                yield "EventChannel", literal, "DEFINES_CHANNEL", ".".join(block), n
            elif key == "event_source_arn" and reference:
                yield "EventChannel", ".".join(reference.split(".")[:2]), "CONSUMES_EVENT", ".".join(block), n
            elif literal and _DOMAIN.fullmatch(literal.lower()):
                yield "Domain", literal.lower(), "REFERENCES_DOMAIN", ".".join(block), n
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            block, depth = None, 0


@adapter("config-zappa", "zappa_settings.json", "DEPLOYS_VIA_CONFIG CONSUMES_EVENT ROUTES_DOMAIN_TO_DEPLOY")
def zappa(path: str, text: str) -> Iterator[Row]:
    for stage, s in json.loads(text).items():
        if isinstance(s, dict):
            target = f"{s.get('project_name', 'app')}-{stage}"
            yield "DeployTarget", target, "DEPLOYS_VIA_CONFIG", "zappa_lambda", 1
            if s.get("domain"):
                yield "Domain", s["domain"].lower(), "ROUTES_DOMAIN_TO_DEPLOY", target, 1
            for event in s.get("events") or []:
                if arn := (event.get("event_source") or {}).get("arn"):
                    yield "EventChannel", arn.rsplit(":", 1)[-1], "CONSUMES_EVENT", target, 1


@adapter("config-apache-vhost", "*.conf *.vhost", "ROUTES_DOMAIN_TO_DEPLOY")
def vhost(path: str, text: str) -> Iterator[Row]:
    names: list[tuple[str, int]] = []
    scripts: list[str] = []
    inside = False
    for n, line in numbered(text):
        said = line.strip()
        if re.match(r"(?i)<VirtualHost\b", said):
            names, scripts, inside = [], [], True
        elif re.match(r"(?i)</VirtualHost>", said) and inside:
            for name, at in names:
                for script in scripts:
                    yield "Domain", name, "ROUTES_DOMAIN_TO_DEPLOY", script, at
            inside = False
        elif inside and (m := re.match(r"(?i)Server(?:Name|Alias)\s+(.+)", said)):
            names += [(x.split(":")[0].lower(), n) for x in m[1].split()]
        elif inside and (m := re.match(r"(?i)WSGIScriptAlias\s+\S+\s+(\S+)", said)):
            scripts.append(m[1])


_ROUTE_CALLS = ("route", *_METHODS)


@adapter("python-ast", "*.py", "DEFINED_IN IMPORTS CALLS EXPOSES_ENDPOINT REFERENCES_ENV_VAR")
def python_ast(path: str, text: str) -> Iterator[Row]:
    """Symbols, imports, calls by name, decorated routes, and environment reads of one module."""
    module = re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")
    yield "CodeModule", module, "DEFINED_IN", path, 1
    todo: list[tuple[ast.AST, str]] = [(ast.parse(text), "")]
    while todo:
        node, scope = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = f"{scope}.{child.name}".lstrip(".")
                yield "CodeSymbol", f"{module}:{inner}", "DEFINED_IN", module, child.lineno
                for d in child.decorator_list:
                    if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in _ROUTE_CALLS and d.args:
                        route = d.args[0]
                        if isinstance(route, ast.Constant) and isinstance(route.value, str):
                            listed = next((k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List)), None)
                            methods = [e.value for e in listed.elts if isinstance(e, ast.Constant)] if listed else ["GET" if d.func.attr == "route" else d.func.attr]
                            for m in methods:
                                yield "Endpoint", f"{m.upper()} {route.value}", "EXPOSES_ENDPOINT", f"{module}:{inner}", d.lineno
            elif isinstance(child, ast.Import):
                for a in child.names:
                    yield "CodeModule", module, "IMPORTS", a.name, child.lineno
            elif isinstance(child, ast.ImportFrom):
                yield "CodeModule", module, "IMPORTS", "." * child.level + (child.module or ""), child.lineno
            elif isinstance(child, ast.Call):
                name = ast.unparse(child.func)
                if re.fullmatch(r"[\w.]+", name):
                    yield "CodeSymbol", f"{module}:{scope}", "CALLS", name, child.lineno
                if name in ("os.getenv", "os.environ.get") and child.args and isinstance(child.args[0], ast.Constant):
                    yield "EnvVar", str(child.args[0].value), "REFERENCES_ENV_VAR", module, child.lineno
            todo.append((child, inner))


def constants(tree: ast.AST) -> dict[str, str]:
    """Names that a module binds once, to a text that can be told; later ones may build on earlier ones."""
    bound: dict[str, list[ast.expr]] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            bound.setdefault(node.targets[0].id, []).append(node.value)
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name) and node.value is not None:
            bound.setdefault(node.target.id, []).append(node.value)
    known: dict[str, str] = {}
    for _ in range(len(bound)):
        more = {k: t for k, v in bound.items() if k not in known and len(v) == 1 and (t := text_of(v[0], known)) is not None}
        if not more:
            break
        known |= more
    return known


def text_of(node: ast.AST | None, known: dict[str, str]) -> str | None:
    """The text of an expression of literals and known names; parts of an f-string that can't be told become ``{}``."""
    if isinstance(node, ast.Constant):
        return node.value if isinstance(node.value, str) else None
    if isinstance(node, ast.Name):
        return known.get(node.id)
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = text_of(node.left, known), text_of(node.right, known)
        return None if a is None or b is None else a + b
    if isinstance(node, ast.JoinedStr):
        parts = [text_of(v.value if isinstance(v, ast.FormattedValue) else v, known) for v in node.values]
        return "".join("{}" if x is None else x for x in parts)
    return None


def _calls(text: str) -> Iterator[tuple[ast.Call, dict[str, str]]]:
    tree = ast.parse(text)
    known = constants(tree)
    yield from ((node, known) for node in ast.walk(tree) if isinstance(node, ast.Call))


_CLIENTS = ("requests", "httpx", "session", "client", "self.session", "self.client")


@adapter("python-http-client", "*.py", "CALLS_ENDPOINT")
def http_client(path: str, text: str) -> Iterator[Row]:
    """Calls of HTTP clients whose URL or path can be told."""
    for call, known in _calls(text):
        f = call.func
        if isinstance(f, ast.Attribute) and f.attr in (*_METHODS, "request") and ast.unparse(f.value) in _CLIENTS:
            args = list(call.args)
            method = text_of(args.pop(0), known) if f.attr == "request" and args else f.attr
            url = text_of(args[0] if args else next((k.value for k in call.keywords if k.arg == "url"), None), known)
            if url and method and (url.startswith("/") or "://" in url):
                yield "Endpoint", f"{method.upper()} {url}", "CALLS_ENDPOINT", path, call.lineno


# Calls of the cloud's clients and resources by service, factory and method: the argument that names the channel, and the direction.
TRANSPORT = {
    ("sqs", "client", "send_message"): ("QueueUrl", "PRODUCES_EVENT"),
    ("sqs", "client", "send_message_batch"): ("QueueUrl", "PRODUCES_EVENT"),
    ("sqs", "client", "receive_message"): ("QueueUrl", "CONSUMES_EVENT"),
    ("sqs", "resource", "send_message"): (None, "PRODUCES_EVENT"),
    ("sqs", "resource", "receive_messages"): (None, "CONSUMES_EVENT"),
    ("sns", "client", "publish"): ("TopicArn", "PRODUCES_EVENT"),
}
_CHANNEL_ARN = re.compile(r"arn:aws:(sqs|sns):[A-Za-z0-9-]+:[0-9]+:([A-Za-z0-9_-]+(?:\.fifo)?)")
_CHANNEL_URL = re.compile(r"https?://sqs\.[A-Za-z0-9-]+\.amazonaws\.com/[0-9]+/([A-Za-z0-9_-]+(?:\.fifo)?)")


def channel_of(service: str, value: str, bare: bool) -> str | None:
    """``broker:address`` of an ARN, a queue URL or, if ``bare``, a queue's name."""
    if m := _CHANNEL_ARN.fullmatch(value.strip()):
        return f"{m[1]}:{m[2]}" if m[1] == service else None
    if service == "sqs" and (m := _CHANNEL_URL.fullmatch(value.strip())):
        return f"sqs:{m[1]}"
    return f"sqs:{value}" if bare and re.fullmatch(r"[A-Za-z0-9_-]{1,80}|[A-Za-z0-9_-]{1,75}\.fifo", value) else None


class _Bound:
    """What the names of a module and of one function are bound to: (service, factory) of clients, (argument, whether a bare name) of queues."""

    def __init__(self, cloud: set[str], known: dict[str, str]):
        self.cloud, self.known, self.clients, self.queues = cloud, known, {}, {}

    def inner(self) -> _Bound:
        out = _Bound(self.cloud, self.known)
        out.clients, out.queues = dict(self.clients), dict(self.queues)
        return out

    def client(self, node: ast.AST | None) -> tuple[str, str] | None:
        if isinstance(node, ast.Name):
            return self.clients.get(node.id)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("client", "resource") and node.args:
            base, service = node.func.value, text_of(node.args[0], self.known)
            session = isinstance(base, ast.Call) and isinstance(base.func, ast.Attribute) and base.func.attr == "Session" and ast.unparse(base.func.value) in self.cloud
            if service in ("sqs", "sns") and (session or ast.unparse(base) in self.cloud):
                return service, node.func.attr
        return None

    def queue(self, node: ast.AST | None) -> tuple[ast.AST, bool] | None:
        if isinstance(node, ast.Name):
            return self.queues.get(node.id)
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and self.client(node.func.value) == ("sqs", "resource"):
            named = next((k.value for k in node.keywords if k.arg == "QueueName"), None)
            if node.func.attr == "Queue" and node.args:
                return node.args[0], False
            if node.func.attr == "get_queue_by_name" and named is not None:
                return named, True
        return None

    def bind(self, node: ast.stmt) -> None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        for t in targets:
            if isinstance(t, ast.Name):
                client, queue = self.client(node.value), self.queue(node.value)
                self.clients.pop(t.id, None)
                self.queues.pop(t.id, None)
                if client:
                    self.clients[t.id] = client
                elif queue:
                    self.queues[t.id] = queue


@adapter("python-boto3-transport", "*.py", "PRODUCES_EVENT CONSUMES_EVENT UNRESOLVED_CHANNEL")
def transport(path: str, text: str) -> Iterator[Row]:
    """Calls on queues and topics whose client comes from the cloud's library; a channel that can't be told is reported as such.

    A local function that passes its argument on counts for its callers, two calls deep at most.
    """
    tree = ast.parse(text)
    known = constants(tree)
    cloud = {a.asname or a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names if a.name == "boto3"}
    top = _Bound(cloud, known)
    for node in tree.body:
        top.bind(node)
    functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
    named = {f.name: f for f in tree.body if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef)}

    def events(f: ast.AST, known: dict[str, str], depth: int) -> Iterator[tuple[ast.Call, str, str, ast.AST, dict, bool]]:
        bound = top.inner()
        bound.known = known
        todo = list(ast.iter_child_nodes(f))[::-1]
        while todo:
            node = todo.pop()
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                continue
            if isinstance(node, ast.Call):
                found = False
                if isinstance(node.func, ast.Attribute):
                    method, receiver = node.func.attr, node.func.value
                    if (queue := bound.queue(receiver)) and (spec := TRANSPORT.get(("sqs", "resource", method))):
                        found = True
                        yield node, "sqs", spec[1], queue[0], known, queue[1]
                    elif (client := bound.client(receiver)) and (spec := TRANSPORT.get((*client, method))) and spec[0]:
                        given = next((k.value for k in node.keywords if k.arg == spec[0]), None)
                        if given is not None:
                            found = True
                            yield node, client[0], spec[1], given, known, False
                wrapper = named.get(node.func.id) if isinstance(node.func, ast.Name) else None
                if not found and wrapper is not None and wrapper is not f and depth < 2:
                    names = [a.arg for a in wrapper.args.args]
                    given = dict(zip(names, node.args, strict=False)) | {k.arg: k.value for k in node.keywords if k.arg in names}
                    told = {n: t for n, v in given.items() if (t := text_of(v, known)) is not None}
                    if told:
                        inner = list(events(wrapper, {**top.known, **told}, depth + 1))
                        if len(inner) == 1:
                            yield (node, *inner[0][1:])
            todo += list(ast.iter_child_nodes(node))[::-1]
            if isinstance(node, ast.Assign | ast.AnnAssign):
                bound.bind(node)

    for f in functions:
        local = {a.arg for a in (*f.args.args, *f.args.kwonlyargs)}
        for call, service, relation, argument, told, bare in events(f, {k: v for k, v in known.items() if k not in local}, 0):
            value = text_of(argument, told)
            name = channel_of(service, value, bare) if value is not None else None
            if name:
                yield "EventChannel", name, relation, path, call.lineno
            else:
                yield "EventChannel", ast.unparse(argument), "UNRESOLVED_CHANNEL", path, call.lineno


@adapter("python-web-routes", "*.py", "EXPOSES_ENDPOINT")
def web_routes(path: str, text: str) -> Iterator[Row]:
    """Routers with a prefix, and tables of ``path()`` and ``re_path()``."""
    tree = ast.parse(text)
    known, prefix = constants(tree), {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Assign) and isinstance(node.value, ast.Call) and isinstance(node.targets[0], ast.Name):
            given = {k.arg: text_of(k.value, known) for k in node.value.keywords}
            if found := given.get("prefix") or given.get("url_prefix"):
                prefix[node.targets[0].id] = found.rstrip("/")
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            for d in node.decorator_list:
                if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.func.value.id in prefix and d.args:
                    route = text_of(d.args[0], known)
                    if route is not None and d.func.attr in _ROUTE_CALLS:
                        method = "GET" if d.func.attr == "route" else d.func.attr.upper()
                        yield "Endpoint", f"{method} {prefix[d.func.value.id]}/{route.lstrip('/')}", "EXPOSES_ENDPOINT", node.name, d.lineno
        elif isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name) and node.targets[0].id == "urlpatterns" and isinstance(node.value, ast.List):
            for e in node.value.elts:
                if isinstance(e, ast.Call) and isinstance(e.func, ast.Name) and e.func.id in ("path", "re_path") and len(e.args) > 1:
                    route = text_of(e.args[0], known)
                    if route is not None and not ast.unparse(e.args[1]).startswith("include("):
                        yield "Endpoint", f"ANY /{route.lstrip('^/').rstrip('$')}", "EXPOSES_ENDPOINT", ast.unparse(e.args[1]), e.lineno


_JS_IMPORT = re.compile(r"""(?:\bimport\s+(?:[^'"]*?\sfrom\s+)?|\brequire\(\s*|\bexport\s+[^'"]*?\sfrom\s+)['"]([^'"]+)['"]""")
_JS_ROUTE = re.compile(r"""\b(?:app|router|server|fastify)\.(get|put|post|delete|patch|options|head|all)\(\s*['"`](/[^'"`]*)['"`]""")
_JS_FETCH = re.compile(r"""\b(?:fetch|axios(?:\.(get|put|post|delete|patch))?)\(\s*['"`]((?:https?://|/)[^'"`]*)['"`]""")


@adapter("typescript-text", "*.ts *.tsx *.js *.jsx", "IMPORTS EXPOSES_ENDPOINT CALLS_ENDPOINT")
def typescript(path: str, text: str) -> Iterator[Row]:
    """Imports, server routes and client calls that are literals; without a parser nothing is resolved."""
    for n, line in numbered(text):
        for name in _JS_IMPORT.findall(line):
            yield "CodeModule", path, "IMPORTS", name, n
        for method, route in _JS_ROUTE.findall(line):
            yield "Endpoint", f"{'ANY' if method == 'all' else method.upper()} {route}", "EXPOSES_ENDPOINT", path, n
        for method, url in _JS_FETCH.findall(line):
            yield "Endpoint", f"{(method or 'GET').upper()} {url}", "CALLS_ENDPOINT", path, n


_CS_CLASS = re.compile(r"\bclass\s+(\w+)")
_CS_ROUTE = re.compile(r'\[Route\("([^"]*)"\)\]')
_CS_VERB = re.compile(r'\[Http(Get|Put|Post|Delete|Patch)(?:\("([^"]*)"\))?')
_CS_MAP = re.compile(r'\.Map(Get|Put|Post|Delete|Patch)\(\s*"([^"]*)"')


@adapter("dotnet-endpoints", "*.cs", "EXPOSES_ENDPOINT DEFINED_IN")
def dotnet(path: str, text: str) -> Iterator[Row]:
    """Controllers' routes, joined to the nearest class before them, and minimal APIs."""
    prefix = pending = owner = ""
    for n, line in numbered(text):
        if m := _CS_ROUTE.search(line):
            pending = m[1]
        if m := _CS_CLASS.search(line):
            owner, prefix, pending = m[1], pending, ""
            yield "CodeSymbol", owner, "DEFINED_IN", path, n
        for verb, route in _CS_VERB.findall(line):
            whole = "/".join(x.strip("/") for x in (prefix, route) if x).replace("[controller]", owner.removesuffix("Controller").lower())
            yield "Endpoint", f"{verb.upper()} /{whole}", "EXPOSES_ENDPOINT", owner, n
        for verb, route in _CS_MAP.findall(line):
            yield "Endpoint", f"{verb.upper()} /{route.lstrip('/')}", "EXPOSES_ENDPOINT", path, n


_CHANNEL = re.compile(r"(?i)\b(?:queue|topic|channel)(?:_name|_url|name)?\s*[:=]\s*['\"]?([A-Za-z0-9][A-Za-z0-9_.:/-]{2,})")


@adapter("event-channel-text", "*.ini *.cfg *.properties *.txt", "REFERENCES_EVENT_CHANNEL")
def channels(path: str, text: str) -> Iterator[Row]:
    for n, line in numbered(text):
        for name in _CHANNEL.findall(line):
            yield "EventChannel", re.split(r"[:/]", name)[-1], "REFERENCES_EVENT_CHANNEL", path, n


_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(.*)$")


def _requirement(line: str) -> tuple[str, str] | None:
    m = _REQUIREMENT.match(line.split("#")[0])
    return (m[1], "git_url" if "git+" in m[2] else "registry") if m else None


@adapter("package-manifests", "requirements*.txt pyproject.toml package.json *.csproj", "DEPENDS_ON")
def manifests(path: str, text: str) -> Iterator[Row]:
    """Declared dependencies with the form of their version."""
    name = path.rsplit("/", 1)[-1]
    if name == "package.json":
        doc = json.loads(text)
        for group in ("dependencies", "devDependencies", "peerDependencies"):
            for package, version in (doc.get(group) or {}).items():
                form = "workspace" if version.startswith("workspace:") else "file_path" if version.startswith(("file:", "link:")) else "git_url" if "git" in version or "/" in version else "registry"
                yield "ExternalPackage", package, "DEPENDS_ON", form, 1
    elif name == "pyproject.toml":
        project = tomllib.loads(text).get("project") or {}
        for line in [*project.get("dependencies", []), *(x for v in (project.get("optional-dependencies") or {}).values() for x in v)]:
            if found := _requirement(line):
                yield "ExternalPackage", found[0], "DEPENDS_ON", found[1], 1
    elif name.endswith(".csproj"):
        for n, line in numbered(text):
            if m := re.search(r'<(Package|Project)Reference\s+Include="([^"]+)"', line):
                yield "ExternalPackage", m[2], "DEPENDS_ON", "registry" if m[1] == "Package" else "file_path", n
    else:
        for n, line in numbered(text):
            if not line.lstrip().startswith("-") and (found := _requirement(line)):
                yield "ExternalPackage", found[0], "DEPENDS_ON", found[1], n


ROWS = "adapter string, path string, kind string, name string, relation string, target string, line int, error string"


def chosen(path: str, only: tuple[str, ...] | None = None) -> list[str]:
    name = path.rsplit("/", 1)[-1]
    return [k for k, (patterns, _, _) in ADAPTERS.items() if (only is None or k in only) and any(fnmatch(name, p) for p in patterns)]


def run_file(path: str, text: str, only: tuple[str, ...] | None = None) -> Iterator[tuple]:
    """ROWS of one file: each adapter's rows once, or its error; an undeclared relation is an error."""
    for name in chosen(path, only):
        _, relations, f = ADAPTERS[name]
        try:
            rows = list(dict.fromkeys(f(path, text)))
            if bad := {r[2] for r in rows} - relations:
                raise ValueError(f"undeclared relations: {sorted(bad)}")
            yield from ((name, path, *r, None) for r in rows)
        except Exception as e:  # one file of a fleet must not stop the build: the error is a row
            yield name, path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]


def extract(files: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """ROWS from files (path, text); null texts give none."""
    columns = [c.split()[0] for c in ROWS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = [r for p, t in zip(df["path"], df["text"], strict=True) if t is not None for r in run_file(p, t, only)]
            out = pd.DataFrame(rows, columns=columns)
            yield out.assign(line=out["line"].astype("Int32"))

    return files.select("path", "text").mapInPandas(run, ROWS)


def coverage(rows: DataFrame) -> DataFrame:
    """(adapter, state, files): where an adapter worked, and where it failed."""
    state = F.when(F.col("error").isNull(), "instrumented").otherwise("uninstrumented")
    return rows.groupBy("adapter", state.alias("state")).agg(F.count_distinct("path").alias("files"))


def refused_stacks(imports: DataFrame, stacks: dict[str, str], handled: tuple[str, ...]) -> DataFrame:
    """(stack, files, reason): frameworks that are imported, by the packages of ``stacks``, and that no adapter handles."""
    table = imports.sparkSession.createDataFrame(list(stacks.items()) or [("", "")], "package string, stack string")
    rows = imports.withColumn("package", F.lower(F.regexp_extract("target", r"^@?[^./]+(?:/[^/]+)?", 0)))
    rows = rows.withColumn("package", F.when(F.startswith("package", F.lit("@")), F.col("package")).otherwise(F.substring_index("package", "/", 1)))
    found = rows.join(F.broadcast(table), "package").where(~F.col("stack").isin(*handled, ""))  # the table is configuration
    return found.groupBy("stack").agg(F.count_distinct("path").alias("files"), F.lit("no_adapter_for_known_stack").alias("reason"))


def selected(rows: DataFrame) -> DataFrame:
    """(service, target): workloads whose labels hold all of a service's selector, in its namespace."""
    pairs = lambda r, who: rows.where(F.col("relation") == r).select(F.col("name").alias(who), F.substring_index("name", "/", 1).alias("ns"), F.col("target").alias("pair")).distinct()
    wanted = pairs("SELECTS", "service")
    need = wanted.groupBy("service").agg(F.count("*").alias("need"))
    met = wanted.join(pairs("HAS_LABEL", "target"), ["ns", "pair"]).groupBy("service", "target").agg(F.count("*").alias("met"))
    return met.join(need, "service").where("met = need").select("service", "target")


from . import frameworks, languages  # noqa: E402, F401  (they add their adapters, on the workers too)
