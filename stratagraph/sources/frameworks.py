"""Adapters for what Python says by its frameworks: receivers of calls, models and what uses them, and authorisation.

A name is reported as the dotted name that the file's imports make of it; which symbol that is, is for joins over the
whole repository (``linking.typed_calls``, ``linking.named_symbols``).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .adapters import Row, adapter, text_of

# Field types of models, those that relate, and what decorators, permissions, calls and attributes allow.
FIELDS = (
    "AutoField", "BigAutoField", "BigIntegerField", "BooleanField", "CharField", "DateField", "DateTimeField", "DecimalField", "EmailField", "FloatField", "ForeignKey", "IntegerField",
    "ManyToManyField", "OneToOneField", "PositiveIntegerField", "SlugField", "TextField", "URLField", "UUIDField",
)
RELATIONS = ("ForeignKey", "OneToOneField", "ManyToManyField")
PERMISSIONS = {
    "AllowAny": "public", "IsAuthenticated": "authenticated", "IsAdminUser": "privileged", "DjangoModelPermissions": "model_permissions", "DjangoObjectPermissions": "object_permissions",
}
DECORATORS = {
    "django.contrib.auth.decorators.login_required": "authenticated", "django.contrib.auth.decorators.permission_required": "permission_required",
    "flask_login.login_required": "authenticated", "flask_jwt_extended.jwt_required": "authenticated",
}
CHECK_CALLS = {"self.check_permissions": "permission_check", "self.check_object_permissions": "object_permission_check", "request.user.has_perm": "permission_check"}
CHECK_ATTRIBUTES = {
    "request.user.is_authenticated": "authenticated", "request.user.is_staff": "privileged", "request.user.is_superuser": "privileged", "current_user.is_authenticated": "authenticated",
}
DENIALS = {
    "django.core.exceptions.PermissionDenied": "permission_denied", "rest_framework.exceptions.NotAuthenticated": "not_authenticated",
    "rest_framework.exceptions.AuthenticationFailed": "authentication_failed", "rest_framework.exceptions.PermissionDenied": "permission_denied",
}

Function = ast.FunctionDef | ast.AsyncFunctionDef


def module_of(path: str) -> str:
    return re.sub(r"(/__init__)?\.py$", "", path).replace("/", ".")


def dotted(node: ast.AST | None) -> str | None:
    """``a.b.c`` of a name or of attributes of one."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


class Names:
    """What the names at a module's top mean: imported ones by where they come from, its own by the module."""

    def __init__(self, module: str, tree: ast.Module, package: bool):
        self.module, self.known = module, {}
        base = module.split(".") if package else module.split(".")[:-1]
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.known[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            elif isinstance(node, ast.ImportFrom):
                up = base[: len(base) - node.level + 1] if node.level else []
                for a in node.names:
                    self.known[a.asname or a.name] = ".".join([*up, *([node.module] if node.module else []), a.name])
        for node in tree.body:
            if isinstance(node, Function | ast.ClassDef):
                self.known[node.name] = f"{module}.{node.name}"

    def __call__(self, node: ast.AST | None) -> str | None:
        name = dotted(node)
        if name is None:
            return None
        head, _, rest = name.partition(".")
        start = self.known.get(head, head)
        return f"{start}.{rest}" if rest else start


def scopes(tree: ast.AST, scope: str = "") -> Iterator[tuple[str, ast.AST, ast.ClassDef | None]]:
    """(qualname, node, class around it) of every function and class."""
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, Function | ast.ClassDef):
            name = f"{scope}.{node.name}".lstrip(".")
            yield name, node, tree if isinstance(tree, ast.ClassDef) else None
            yield from scopes(node, name)
        elif not isinstance(node, ast.expr):
            yield from scopes(node, scope)


class _Typed:
    """Calls in one body, in order, with the classes that local names are bound to: an expression, or None for what can't be told."""

    def __init__(self, caller: str, bound: dict[str, str | None]):
        self.caller, self.bound, self.rows = caller, bound, []

    def expression(self, node: ast.AST | None) -> None:
        for call in [n for n in ast.walk(node) if isinstance(n, ast.Call)] if node is not None else ():
            f = call.func
            if isinstance(f, ast.Attribute):
                made = self.bound.get(f.value.id) if isinstance(f.value, ast.Name) else self.made(f.value)
                if made:
                    self.rows.append(("CodeSymbol", self.caller, "CALLS_METHOD", f"{made}|{f.attr}", call.lineno))
            if made := self.made(call):
                self.rows.append(("CodeSymbol", self.caller, "CONSTRUCTS", made, call.lineno))

    def made(self, node: ast.AST | None) -> str | None:
        """The name that a call calls, unless it is local."""
        if not isinstance(node, ast.Call):
            return None
        name = dotted(node.func)
        return name if name and name.split(".")[0] not in self.bound else None

    def bind(self, target: ast.AST, made: str | None) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name):
                self.bound[n.id] = made if n is target else None

    def branch(self, body: list[ast.stmt], target: ast.AST | None = None) -> None:
        inner = _Typed(self.caller, dict(self.bound))
        if target is not None:
            inner.bind(target, None)
        inner.statements(body)
        self.rows += inner.rows
        for name, made in inner.bound.items():  # what a branch may change can't be told after it
            if self.bound.get(name, "") != made:
                self.bound[name] = None

    def statements(self, body: list[ast.stmt]) -> None:
        for s in body:
            if isinstance(s, Function | ast.ClassDef):
                self.bound[s.name] = None
            elif isinstance(s, ast.Assign | ast.AnnAssign):
                self.expression(s.value)
                made = self.made(s.value)
                for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                    self.bind(t, made)
            elif isinstance(s, ast.AugAssign):
                self.expression(s.value)
                self.bind(s.target, None)
            elif isinstance(s, ast.Import | ast.ImportFrom):
                for a in s.names:
                    self.bound[a.asname or a.name.split(".")[0]] = None
            elif isinstance(s, ast.For | ast.AsyncFor):
                self.expression(s.iter)
                self.branch(s.body, s.target)
                self.branch(s.orelse)
            elif isinstance(s, ast.While | ast.If):
                self.expression(s.test)
                self.branch(s.body)
                self.branch(s.orelse)
            elif isinstance(s, ast.With | ast.AsyncWith):
                for item in s.items:
                    self.expression(item.context_expr)
                names = [i.optional_vars for i in s.items if i.optional_vars is not None]
                self.branch(s.body, ast.Tuple(names) if names else None)
            elif isinstance(s, ast.Try | ast.TryStar):
                self.branch(s.body)
                for h in s.handlers:
                    self.branch(h.body, ast.Name(h.name) if h.name else None)
                self.branch(s.orelse)
                self.branch(s.finalbody)
            elif isinstance(s, ast.Match):
                self.expression(s.subject)
                for c in s.cases:
                    self.branch(c.body)
            else:
                for n in ast.iter_child_nodes(s):
                    self.expression(n)


@adapter("python-receivers", "*.py", "HAS_KIND IMPORTS_NAME CALLS_METHOD CONSTRUCTS")
def receivers(path: str, text: str) -> Iterator[Row]:
    """Kinds of symbols, imported names, and calls on what a body constructs: the class as it is written there, and the method."""
    tree, module = ast.parse(text), module_of(path)
    for node in ast.walk(tree):
        if isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield "CodeModule", module, "IMPORTS_NAME", f"{'.' * node.level}{node.module or ''}|{a.name}|{a.asname or a.name}", node.lineno
        elif isinstance(node, ast.Import):
            for a in node.names:
                if a.asname or "." not in a.name:
                    yield "CodeModule", module, "IMPORTS_NAME", f"{a.name}||{a.asname or a.name}", node.lineno
    for name, node, inside in scopes(tree):
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if inside is not None else "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function"
        yield "CodeSymbol", f"{module}:{name}", "HAS_KIND", kind, node.lineno
        if isinstance(node, Function):
            given = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *(a for a in (node.args.vararg, node.args.kwarg) if a)]
            body = _Typed(f"{module}:{name}", dict.fromkeys((a.arg for a in given)))
            body.statements(node.body)
            yield from body.rows
    top = _Typed(f"{module}:", {})
    top.statements([s for s in tree.body if not isinstance(s, Function | ast.ClassDef | ast.Import | ast.ImportFrom)])
    yield from top.rows


def _framed(tree: ast.Module, roots: tuple[str, ...]) -> bool:
    names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and not n.level]
    return any(n.split(".")[0] in roots for n in names)


def _assigned(body: list[ast.stmt]) -> Iterator[tuple[str, ast.expr, int]]:
    for s in body:
        if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
            yield s.targets[0].id, s.value, s.lineno
        elif isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.value is not None:
            yield s.target.id, s.value, s.lineno


def _queried(node: ast.AST, names: Names) -> str | None:
    """The model whose ``objects`` an expression starts from."""
    while isinstance(node, ast.Call | ast.Attribute):
        if isinstance(node, ast.Attribute) and node.attr == "objects":
            return names(node.value)
        node = node.func if isinstance(node, ast.Call) else node.value
    return None


@adapter("python-django-models", "*.py", "DECLARES_FIELD RELATES_TO_MODEL SERIALIZES_MODEL HANDLES_MODEL TASK_USES_MODEL")
def django_models(path: str, text: str) -> Iterator[Row]:
    """Models with their fields and relations, and the serializers, views and tasks that name a model; models by dotted name, or by label."""
    tree, module = ast.parse(text), module_of(path)
    if not _framed(tree, ("django", "rest_framework", "celery")):
        return
    names = Names(module, tree, path.endswith("__init__.py"))
    for qualname, node, _ in scopes(tree):
        symbol = f"{module}:{qualname}"
        if isinstance(node, ast.ClassDef):
            bases = [names(b) or "" for b in node.bases]
            own = dict((n, v) for n, v, _ in _assigned(node.body))
            if any(b == "django.db.models.Model" or b.endswith(".models.Model") for b in bases):
                for name, value, line in _assigned(node.body):
                    kind = (names(value.func) or "").split(".")[-1] if isinstance(value, ast.Call) else ""
                    if kind in FIELDS and (names(value.func) or "").startswith("django.db.models"):
                        yield "CodeSymbol", symbol, "DECLARES_FIELD", f"{symbol}.{name}|{kind}", line
                        if kind in RELATIONS:
                            to = value.args[0] if value.args else next((k.value for k in value.keywords if k.arg == "to"), None)
                            said = text_of(to, {}) or names(to)
                            target = f"{module}.{qualname}" if said == "self" else said
                            if target:
                                yield "CodeSymbol", f"{symbol}.{name}", "RELATES_TO_MODEL", target, line
            if any(b.split(".")[-1] in ("ModelSerializer", "HyperlinkedModelSerializer") for b in bases):
                meta = next((s for s in node.body if isinstance(s, ast.ClassDef) and s.name == "Meta"), None)
                model = next((names(v) for n, v, _ in _assigned(meta.body) if n == "model"), None) if meta else None
                if model:
                    yield "CodeSymbol", symbol, "SERIALIZES_MODEL", model, node.lineno
            elif model := _queried(own["queryset"], names) if "queryset" in own else names(own.get("model")) if bases and "model" in own and node.name != "Meta" else None:
                yield "CodeSymbol", symbol, "HANDLES_MODEL", model, node.lineno
        elif any((names(d.func if isinstance(d, ast.Call) else d) or "").split(".")[-1] in ("shared_task", "task") for d in node.decorator_list):
            for model in sorted({m for n in ast.walk(node) if isinstance(n, ast.Attribute) and n.attr == "objects" and (m := names(n.value))}):
                yield "CodeSymbol", symbol, "TASK_USES_MODEL", model, node.lineno


@adapter("python-authz", "*.py", "HANDLES_ENDPOINT DEFINES_AUTHZ_POLICY APPLIES_AUTHZ_POLICY USES_AUTHZ_CHECK")
def authz(path: str, text: str) -> Iterator[Row]:
    """Handlers of routes, permission classes, and the policies and checks on handlers with what they allow: ``name|access``."""
    tree, module = ast.parse(text), module_of(path)
    names = Names(module, tree, path.endswith("__init__.py"))
    framed = _framed(tree, ("django", "rest_framework", "flask", "flask_jwt_extended", "flask_login"))
    for name, value, line in _assigned(tree.body):
        for e in value.elts if name == "urlpatterns" and isinstance(value, ast.List) else ():
            if isinstance(e, ast.Call) and dotted(e.func) in ("path", "re_path") and len(e.args) > 1:
                route, view = text_of(e.args[0], {}), e.args[1]
                if isinstance(view, ast.Call) and isinstance(view.func, ast.Attribute) and view.func.attr == "as_view":
                    view = view.func.value
                if route is not None and (handler := names(view)):
                    yield "CodeSymbol", handler, "HANDLES_ENDPOINT", f"ANY /{route.lstrip('^/').rstrip('$')}", line
    for qualname, node, _ in scopes(tree):
        symbol = f"{module}.{qualname}"
        if isinstance(node, ast.ClassDef) and framed:
            if any((names(b) or "").split(".")[-1] == "BasePermission" for b in node.bases):
                yield "CodeSymbol", symbol, "DEFINES_AUTHZ_POLICY", "rest_framework.permissions.BasePermission|", node.lineno
            for name, value, line in _assigned(node.body):
                for e in value.elts if name == "permission_classes" and isinstance(value, ast.List | ast.Tuple) else ():
                    if policy := names(e):
                        yield "CodeSymbol", symbol, "APPLIES_AUTHZ_POLICY", f"{policy}|{PERMISSIONS.get(policy.split('.')[-1], 'custom')}", line
        elif isinstance(node, Function):
            for d in node.decorator_list:
                call = d.func if isinstance(d, ast.Call) else d
                said = names(call) or ""
                if said in DECORATORS:
                    yield "CodeSymbol", symbol, "APPLIES_AUTHZ_POLICY", f"{said}|{DECORATORS[said]}", d.lineno
                if isinstance(d, ast.Call) and isinstance(call, ast.Attribute) and call.attr == "route" and d.args and (route := text_of(d.args[0], {})) is not None:
                    listed = next((k.value for k in d.keywords if k.arg == "methods" and isinstance(k.value, ast.List | ast.Tuple)), None)
                    for m in [e.value for e in listed.elts if isinstance(e, ast.Constant)] if listed else ["GET"]:
                        yield "CodeSymbol", symbol, "HANDLES_ENDPOINT", f"{m.upper()} {route}", d.lineno
            for n in ast.walk(node) if framed else ():
                if isinstance(n, ast.Call) and (said := dotted(n.func)) in CHECK_CALLS:
                    yield "CodeSymbol", symbol, "USES_AUTHZ_CHECK", f"{said}|{CHECK_CALLS[said]}", n.lineno
                elif isinstance(n, ast.Attribute) and (said := dotted(n)) in CHECK_ATTRIBUTES:
                    yield "CodeSymbol", symbol, "USES_AUTHZ_CHECK", f"{said}|{CHECK_ATTRIBUTES[said]}", n.lineno
                elif isinstance(n, ast.Raise) and n.exc is not None:
                    said = names(n.exc.func if isinstance(n.exc, ast.Call) else n.exc) or ""
                    if said in DENIALS:
                        yield "CodeSymbol", symbol, "USES_AUTHZ_CHECK", f"{said}|{DENIALS[said]}", n.lineno
