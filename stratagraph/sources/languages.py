"""Adapters for constants over modules, messages and clients in scripts, C# symbols, content delivery in Terraform, and opportunities.

Without a parser for a language its text is read by tokens, with comments and strings blanked first.
"""

from __future__ import annotations

import ast
import builtins
import json
import re
from collections.abc import Iterator

from .adapters import Row, adapter, numbered
from .frameworks import Names, dotted, module_of

# Python: calls of what the language brings along, and constants that other modules may use

_BUILTINS = {n for n in dir(builtins) if not n.startswith("_")}


@adapter("python-builtins", "*.py", "CALLS_BUILTIN")
def builtin_calls(path: str, text: str) -> Iterator[Row]:
    """Calls of built-in names that neither the module nor a function around the call binds."""
    tree, module = ast.parse(text), module_of(path)

    def bound(node: ast.AST) -> set[str]:
        """Names that a scope binds, functions and classes inside it by their names alone."""
        out, todo = set(), list(ast.iter_child_nodes(node))
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.Lambda):
            out |= {a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(x for x in (node.args.vararg, node.args.kwarg) if x))}
        while todo:
            n = todo.pop()
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                out.add(n.name)
                continue
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                out.add(n.id)
            elif isinstance(n, ast.Import | ast.ImportFrom):
                out |= {a.asname or a.name.split(".")[0] for a in n.names}
            todo += ast.iter_child_nodes(n)
        return out

    def visit(node: ast.AST, scope: str, known: set[str]) -> Iterator[Row]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = known if isinstance(child, ast.ClassDef) else known | bound(child)
                yield from visit(child, f"{scope}.{child.name}".lstrip("."), inner)
                continue
            if isinstance(child, ast.Call) and isinstance(child.func, ast.Name) and child.func.id in _BUILTINS - known:
                yield "ExternalSymbol", f"builtins.{child.func.id}", "CALLS_BUILTIN", f"{module}:{scope}", child.lineno
            yield from visit(child, scope, known)

    yield from visit(tree, "", bound(tree))


# Constants


def _parts(node: ast.AST | None, names: Names) -> list[list[str]] | None:
    """The pieces of a text: ["text", x], ["name", dotted] or ["env", variable, default]; None if it is more than that."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return [["text", node.value]]
    if isinstance(node, ast.Name | ast.Attribute):
        name = names(node)
        return [["name", name]] if name else None
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        a, b = _parts(node.left, names), _parts(node.right, names)
        return a + b if a is not None and b is not None else None
    if isinstance(node, ast.JoinedStr):
        out = [_parts(v.value if isinstance(v, ast.FormattedValue) else v, names) for v in node.values]
        return [p for x in out for p in x] if all(x is not None for x in out) else None
    if isinstance(node, ast.Call) and dotted(node.func) in ("os.getenv", "os.environ.get") and len(node.args) == 2:
        said = [a.value if isinstance(a, ast.Constant) else None for a in node.args]
        return [["env", str(said[0]), said[1]]] if isinstance(said[1], str) else None
    return None


@adapter("python-constants", "*.py", "BOUND_TO")
def python_constants(path: str, text: str) -> Iterator[Row]:
    """Names of a module or class, each with every text that it is bound to, by pieces."""
    tree, module = ast.parse(text), module_of(path)
    names = Names(module, tree, path.endswith("__init__.py"))

    def visit(body: list[ast.stmt], scope: str) -> Iterator[Row]:
        own = {n.id for s in body if isinstance(s, ast.Assign | ast.AnnAssign) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in ast.walk(t) if isinstance(n, ast.Name)}
        for s in body:
            if isinstance(s, ast.ClassDef):
                yield from visit(s.body, f"{scope}.{s.name}")
            elif isinstance(s, ast.If | ast.Try):
                yield from visit([*s.body, *s.orelse, *(x for h in getattr(s, "handlers", []) for x in h.body)], scope)
            target = s.targets[0] if isinstance(s, ast.Assign) and len(s.targets) == 1 else s.target if isinstance(s, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                for n in [n for n in ast.walk(s.value) if isinstance(n, ast.Name)] if s.value is not None else ():
                    names.known.setdefault(n.id, f"{scope if n.id in own else module}.{n.id}")
                parts = _parts(s.value, names)
                if parts is not None:
                    yield "Constant", f"{scope}.{target.id}", "BOUND_TO", json.dumps(parts), s.lineno

    yield from visit(tree.body, module)


# Scripts


def blanked(text: str, quotes: str = "'\"`") -> str:
    """``text`` with comments and the insides of strings as spaces; lines and places stay."""
    out, i, n = list(text), 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i) or text.startswith("/*", i):
            end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i) + 2
            end = n if end < i + 2 else end
            out[i:end] = [x if x == "\n" else " " for x in text[i:end]]
            i = end
        elif c in quotes:
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            out[i + 1 : min(j, n)] = [x if x == "\n" else " " for x in text[i + 1 : min(j, n)]]
            i = j + 1
        else:
            i += 1
    return "".join(out)


_PATTERN = re.compile(r"@(Message|Event)Pattern\(\s*")
_EMIT = re.compile(r"\b(?:this\.)?(\w*[cC]lient\w*)\.(emit|send)\(\s*")
_COMMAND = re.compile(r"\bnew\s+(SendMessage|SendMessageBatch|ReceiveMessage|Publish)Command\(\s*\{[^}]*?\b(QueueUrl|TopicArn)\s*:\s*")
_LITERAL = re.compile(r"""\s*(?:'([^'\n]*)'|"([^"\n]*)"|`([^`$]*)`|\{\s*cmd\s*:\s*['"]([^'"]*)['"]\s*\})""")


@adapter("typescript-message-transport", "*.ts *.tsx *.js *.jsx", "PRODUCES_EVENT CONSUMES_EVENT UNRESOLVED_CHANNEL")
def script_messages(path: str, text: str) -> Iterator[Row]:
    """Handlers and senders of message patterns, and queue and topic commands; a channel that is no literal is reported as such."""
    bare = blanked(text)
    found = [(m.end(), "CONSUMES_EVENT", "pattern") for m in _PATTERN.finditer(bare)]
    found += [(m.end(), "PRODUCES_EVENT", "pattern") for m in _EMIT.finditer(bare)]
    found += [(m.end(), "CONSUMES_EVENT" if m[1] == "ReceiveMessage" else "PRODUCES_EVENT", "sns" if m[1] == "Publish" else "sqs") for m in _COMMAND.finditer(bare)]
    for at, relation, broker in sorted(found):
        line = text.count("\n", 0, at) + 1
        m = _LITERAL.match(text, at)
        name = next((g for g in m.groups() if g), None) if m else None
        if name:
            yield "EventChannel", f"{broker}:{re.split('[:/]', name)[-1] if broker != 'pattern' else name}", relation, path, line
        else:
            yield "EventChannel", re.split(r"[,)}\n]", text[at:], maxsplit=1)[0].strip(), "UNRESOLVED_CHANNEL", path, line


_MOUNT = re.compile(r"\b\w+\.use\(\s*['\"](/[^'\"]*)['\"]\s*,\s*(\w+)\s*\)")
_ROUTER = re.compile(r"\b(\w+)\.(get|put|post|delete|patch|options|head|all)\(\s*['\"`](/[^'\"`]*)['\"`]")
_MADE = re.compile(r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:express\.Router\(|Router\(|new\s+Router\(|express\(|fastify\(|Fastify\()")
_CLIENT = re.compile(r"\b(export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*axios\.create\(\s*\{[^}]*?baseURL\s*:\s*['\"`]([^'\"`$]*)['\"`]")
_NEST = re.compile(r"@Controller\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)")
_NEST_VERB = re.compile(r"@(Get|Post|Put|Delete|Patch|Options|Head|All)\(\s*(?:['\"]([^'\"]*)['\"])?\s*\)")


@adapter("typescript-routes", "*.ts *.tsx *.js *.jsx", "EXPOSES_ENDPOINT EXPORTS_CLIENT CALLS_BY_CLIENT MOUNTS")
def script_routes(path: str, text: str) -> Iterator[Row]:
    """Routers with what they are mounted under in the file, controllers, clients with their base, and calls by name of the client."""
    made, mounts = set(_MADE.findall(text)), {n: p for p, n in _MOUNT.findall(text)}
    join = lambda a, b: "/" + "/".join(x.strip("/") for x in (a, b) if x and x.strip("/"))
    base = ""
    for n, line in numbered(text):
        for name, method, route in _ROUTER.findall(line):
            if name in made:
                yield "Endpoint", f"{'ANY' if method == 'all' else method.upper()} {join(mounts.get(name, ''), route)}", "EXPOSES_ENDPOINT", path, n
            elif name not in ("app", "router", "server", "fastify"):
                yield "Endpoint", f"{'ANY' if method == 'all' else method.upper()} {route}", "CALLS_BY_CLIENT", f"{path}|{name}", n
        for exported, name, url in _CLIENT.findall(line):
            yield "Client", f"{path}|{name}", "EXPORTS_CLIENT", f"{url}|{'exported' if exported else 'local'}", n
        for route, name in _MOUNT.findall(line):
            if name not in made:
                yield "Router", f"{path}|{name}", "MOUNTS", route, n
        if m := _NEST.search(line):
            base = m[1] or ""
        for verb, route in _NEST_VERB.findall(line):
            yield "Endpoint", f"{'ANY' if verb == 'All' else verb.upper()} {join(base, route)}", "EXPOSES_ENDPOINT", path, n


# C#

_CS_TYPE = re.compile(r"\b(class|interface|struct|record|enum)\s+(\w+)")
_CS_METHOD = re.compile(r"(?:\b(?:public|private|protected|internal|static|async|override|virtual|sealed|abstract|partial)\s+)+[\w<>\[\],.?\s]*?\b(\w+)\s*\(")
_CS_CALL = re.compile(r"(?<![\w.])((?:\w+\.)*\w+)\s*(?:<[\w,.\s]+>)?\(")
_CS_WORDS = {"if", "for", "foreach", "while", "switch", "using", "lock", "catch", "return", "nameof", "typeof", "sizeof", "new", "when", "base", "this", "await", "default", "fixed", "checked"}
_CS_PUBLISH = re.compile(r"\.(Publish|Send)(?:<(\w+)>)?\(\s*(?:new\s+(\w+))?")
_CS_CONSUMER = re.compile(r"\bIConsumer<(\w+)>")
_CS_BUS = re.compile(r"\.Create(Sender|Processor|Receiver)\(\s*\"([^\"]+)\"")


@adapter("dotnet-csharp", "*.cs", "HAS_KIND IMPORTS CALLS PRODUCES_EVENT CONSUMES_EVENT")
def csharp(path: str, text: str) -> Iterator[Row]:
    """Types and methods by their braces, usings, calls by name, and messages that are published, consumed or sent over a bus."""
    bare = blanked(text, "\"'")
    space, stack, depth = "", [], 0
    lines = text.splitlines()
    for n, line in enumerate(bare.splitlines(), 1):
        if m := re.match(r"\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", line):
            yield "CodeModule", path, "IMPORTS", m[1], n
            continue
        if m := re.match(r"\s*namespace\s+([\w.]+)", line):
            space = m[1]
            if ";" not in line:
                depth += line.count("{") - line.count("}")
            continue
        name = lambda inner: ":".join([space, ".".join([*(s for s, _ in stack), inner])]) if inner else f"{space}:{'.'.join(s for s, _ in stack)}"
        opened = None
        if m := _CS_TYPE.search(line):
            opened = m[2]
            yield "CodeSymbol", name(m[2]), "HAS_KIND", "class" if m[1] in ("class", "record", "struct") else m[1], n
        elif stack and (m := _CS_METHOD.search(line)) and m[1] not in _CS_WORDS and "=" not in line[: m.start(1)] and " new " not in line[: m.start(1)]:
            opened = m[1]
            yield "CodeSymbol", name(m[1]), "HAS_KIND", "method", n
        if opened is None and stack:
            for called in _CS_CALL.findall(line):
                if called.split(".")[-1] not in _CS_WORDS and called not in _CS_WORDS:
                    yield "CodeSymbol", name(""), "CALLS", called, n
        for verb, generic, new in _CS_PUBLISH.findall(line):
            if generic or new:
                yield "EventChannel", f"message:{generic or new}", "PRODUCES_EVENT", path, n
        for message in _CS_CONSUMER.findall(line):
            yield "EventChannel", f"message:{message}", "CONSUMES_EVENT", path, n
        for what, queue in _CS_BUS.findall(lines[n - 1]):
            yield "EventChannel", f"servicebus:{queue}", "PRODUCES_EVENT" if what == "Sender" else "CONSUMES_EVENT", path, n
        if opened is not None and not ("=>" in line and "{" not in line) and ";" not in line.split(")")[-1]:
            stack.append((opened, depth))
        depth += line.count("{") - line.count("}")
        while stack and "}" in line and depth <= stack[-1][1]:
            stack.pop()


# Terraform


@adapter("terraform-cdn", "*.tf", "HAS_ALIAS HAS_ORIGIN DEFAULTS_TO")
def cdn(path: str, text: str) -> Iterator[Row]:
    """Distributions with their aliases and origins, as literals, ``var.x`` or ``local.x``, and what variables and locals stand for."""
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    block, depth = ("", ""), 0
    for n, raw in numbered(text):
        line = re.split(r"(?:^|\s)(?:#|//)", raw)[0]
        if depth == 0 and (m := re.match(r'\s*(resource|variable|locals|module)\b(?:\s+"([^"]+)")?(?:\s+"([^"]+)")?', line)):
            block = (m[2] or "", m[3] or "") if m[1] == "resource" else (m[1], m[2] or "")
        if block[0] == "aws_cloudfront_distribution":
            target = f"{folder}|{block[0]}.{block[1]}"
            if m := re.match(r"\s*aliases\s*=\s*\[(.*)\]", line):
                for x in re.findall(r'"([^"$]+)"|((?:var|local)\.\w+)', m[1]):
                    yield "Distribution", target, "HAS_ALIAS", x[0].lower() or f"{folder}|{x[1]}", n
            elif m := re.match(r"\s*aliases\s*=\s*((?:var|local)\.\w+)", line):
                yield "Distribution", target, "HAS_ALIAS", f"{folder}|{m[1]}", n
            elif m := re.match(r'\s*domain_name\s*=\s*(?:"([^"$]+)"|(aws_s3_bucket\w*\.\w+))', line):
                yield "Distribution", target, "HAS_ORIGIN", m[1] or f"{folder}|{m[2]}", n
        elif block[0] == "variable" and (m := re.match(r"\s*default\s*=\s*(.+)$", line)):
            for x in re.findall(r'"([^"$]+)"', m[1]):
                yield "Variable", f"{folder}|var.{block[1]}", "DEFAULTS_TO", x.lower(), n
        elif block[0] == "locals" and (m := re.match(r"\s*(\w+)\s*=\s*(.+)$", line)):
            for x in re.findall(r'"([^"$]+)"', m[2]):
                yield "Variable", f"{folder}|local.{m[1]}", "DEFAULTS_TO", x.lower(), n
        depth += line.count("{") - line.count("}")
        if depth <= 0:
            depth = 0
            block = ("", "") if "}" in line else block


# Opportunities: places where a fact is to be expected, found without knowing whether it can be told

_OPPORTUNITIES = (
    ("python", r".*\.py$", "CALLS_ENDPOINT", re.compile(r"\b(?:requests|httpx|aiohttp|urllib3?|session|client)\.(?:get|post|put|patch|delete|request|urlopen)\(")),
    ("typescript", r".*\.[jt]sx?$", "CALLS_ENDPOINT", re.compile(r"\b(?:fetch|axios(?:\.\w+)?|got|ky|superagent\.\w+)\(")),
    ("terraform", r".*\.tf$", "REFERENCES_DOMAIN", re.compile(r'"(?:[a-z0-9-]+\.)+[a-z]{2,24}"')),
)


@adapter("opportunities", "*.py *.ts *.tsx *.js *.jsx *.tf", "CALLS_ENDPOINT REFERENCES_DOMAIN")
def opportunities(path: str, text: str) -> Iterator[Row]:
    """(language, path) with the predicate that a line calls for; the metrics ask whether it was met."""
    for language, files, predicate, pattern in _OPPORTUNITIES:
        if re.match(files, path):
            for n, line in numbered(text):
                if not line.lstrip().startswith(("#", "//", "*")) and pattern.search(line):
                    yield "Opportunity", language, predicate, path, n
