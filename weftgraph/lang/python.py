"""Python source by its syntax tree; by lines where it has a syntax error."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from .model import Found, named_tables

_BRANCHES = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.comprehension)
_SQL = re.compile(r"^\s*(select\s.+\sfrom\s|insert\s+into\s|update\s+\S+\s+set\s|delete\s+from\s|create\s+table\s|with\s+\w+\s+as\s*\()", re.IGNORECASE | re.DOTALL)
_ROUTES = {"get", "post", "put", "delete", "patch", "options", "head", "route"}
_REGISTRY = ("registry", "plugin", "engine", "handler", "map")


def parse(text: str, path: str) -> Found:
    found = Found(path, "py")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _by_lines(found, text)
    lines = text.splitlines()
    doc = (ast.get_docstring(tree) or "").strip().split("\n")[0]
    module = found.node("<module>", "file", f"module {found.path}", 1, max(1, len(lines)), text, story=doc or f"Python module {found.path}")
    _Walk(found, lines, module).body(tree.body, "", module)
    _add_routes(found, tree)
    return found


def _inside(s: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a definition apart from those of definitions in it, which have their own."""
    rest = list(ast.iter_child_nodes(s))
    while rest:
        n = rest.pop()
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            rest += n.decorator_list
            continue
        yield n
        rest += ast.iter_child_nodes(n)


def _aliases(s: ast.AST) -> dict[str, str]:
    """Local names that stand for something else: other names, or what makes the object they hold."""
    out = {}
    for n in _inside(s):
        if isinstance(n, ast.Assign) and len(n.targets) == 1 and isinstance(n.targets[0], ast.Name):
            value = n.value.func if isinstance(n.value, ast.Call) else n.value
            made = isinstance(n.value, ast.Call)
            name = ast.unparse(value) if isinstance(value, (ast.Name, ast.Attribute)) else ""
            if name and (not made or name.split(".")[-1][:1].isupper()) and name != n.targets[0].id:
                out[n.targets[0].id] = name
    return out


def _view(arg: ast.expr) -> str | None:
    """The name of a view: a name, the last part of a dotted one, or the class whose as_view is called."""
    while isinstance(arg, ast.Call):
        arg = arg.func
    if isinstance(arg, ast.Attribute) and arg.attr == "as_view":
        arg = arg.value
    return arg.id if isinstance(arg, ast.Name) else arg.attr if isinstance(arg, ast.Attribute) else None


def _declared_routes(tree: ast.Module) -> Iterator[tuple[str | None, str]]:
    """(view or none, path) of URL tables and of views registered with routers."""
    name = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else ""
    text = lambda a: a.value if isinstance(a, ast.Constant) and isinstance(a.value, str) else None
    for s in tree.body:
        targets = s.targets if isinstance(s, ast.Assign) else [s.target] if isinstance(s, (ast.AnnAssign, ast.AugAssign)) else []
        if any(isinstance(t, ast.Name) and t.id == "urlpatterns" for t in targets) and isinstance(s.value, (ast.List, ast.Tuple)):
            for e in s.value.elts:
                if isinstance(e, ast.Call) and name(e.func) in ("path", "re_path", "url") and e.args and (path := text(e.args[0])) is not None:
                    others = e.args[1:2]
                    below = bool(others) and isinstance(others[0], ast.Call) and name(others[0].func) == "include"
                    path = "/" + path.lstrip("^/")
                    yield (None, path.rstrip("/") or "/") if below else (_view(others[0]) if others else None, path)
    for n in ast.walk(tree):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "register" and len(n.args) > 1 and (path := text(n.args[0])) is not None:
            yield _view(n.args[1]), "/" + path.lstrip("/")


def _add_routes(found: Found, tree: ast.Module) -> None:
    """Declared routes as facts of their views, or of the module where the views are elsewhere."""
    by_name = {}
    for n in found.nodes:
        if n["kind"] in ("function", "method", "class"):
            by_name[n["id"].split("::")[-1].split(".")[-1]] = n
    for view, path in _declared_routes(tree):
        card = by_name.get(view, found.nodes[0])
        card["reads"] = sorted({*card["reads"], f"ROUTE:ANY:{path}"})


class _Walk:
    def __init__(self, found: Found, lines: list[str], module: str):
        self.found, self.lines, self.module = found, lines, module

    def source(self, node: ast.AST) -> str:
        return "\n".join(self.lines[node.lineno - 1 : node.end_lineno])

    def body(self, stmts: list[ast.stmt], prefix: str, scope: str) -> None:
        for s in stmts:
            if isinstance(s, ast.ClassDef):
                self.klass(s, prefix, scope)
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                self.function(s, prefix, scope)
            elif isinstance(s, (ast.Import, ast.ImportFrom)):
                self.imports(s)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                self.variable(s, prefix, scope)
            elif isinstance(s, (ast.If, ast.Try, ast.With)):
                for part in ("body", "orelse", "finalbody"):
                    self.body(getattr(s, part, []), prefix, scope)
                for h in getattr(s, "handlers", []):
                    self.body(h.body, prefix, scope)

    def imports(self, s: ast.Import | ast.ImportFrom) -> None:
        base = "" if isinstance(s, ast.Import) else "." * s.level + (s.module or "")
        for a in s.names:
            dst = a.name if not base else base if a.name == "*" else base + ("" if base.endswith(".") else ".") + a.name
            self.found.edge(self.module, dst, "IMPORTS", s.lineno, f"import {dst} as {a.asname or a.name.split('.')[-1]}")

    def variable(self, s: ast.Assign | ast.AnnAssign, prefix: str, scope: str) -> None:
        for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
            if isinstance(t, ast.Name):
                own = self.found.node(prefix + t.id, "variable", self.source(s).strip().split("\n")[0][:80], s.lineno, s.end_lineno, self.source(s))
                self.found.edge(own, scope, "DEFINED_IN", s.lineno, "assignment", "resolved")
            elif isinstance(t, ast.Subscript) and any(k in ast.unparse(t.value).lower() for k in _REGISTRY) and isinstance(s.value, (ast.Name, ast.Attribute)):
                self.found.edge(scope, ast.unparse(s.value), "CALLS", s.lineno, f"registry {ast.unparse(t.value)}", "dynamic")

    def klass(self, s: ast.ClassDef, prefix: str, scope: str) -> None:
        name, bases = prefix + s.name, [ast.unparse(b) for b in s.bases]
        doc = (ast.get_docstring(s) or "").strip().split("\n")[0]
        own = self.found.node(name, "class", f"class {s.name}({', '.join(bases)})" if bases else f"class {s.name}", s.lineno, s.end_lineno, self.source(s), story=doc)
        self.found.edge(own, scope, "DEFINED_IN", s.lineno, "class", "resolved")
        for b in bases:
            self.found.edge(own, b, "INHERITS", s.lineno, "base class")
        for d in s.decorator_list:
            self.found.edge(own, ast.unparse(d.func if isinstance(d, ast.Call) else d), "CALLS", d.lineno, "decorator", "ambiguous")
        self.body(s.body, name + ".", own)

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, prefix: str, scope: str) -> None:
        found, name = self.found, prefix + s.name
        own, edges = found.id(name), []
        args = [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs, *([s.args.vararg] if s.args.vararg else []), *([s.args.kwarg] if s.args.kwarg else [])]
        params, returns = [ast.unparse(a) for a in args], ast.unparse(s.returns) if s.returns else None
        complexity, calls, reads, writes, raises = 1, 0, set(), set(), set()
        owner = prefix.rstrip(".")
        alias = _aliases(s)
        for n in _inside(s):
            if isinstance(n, _BRANCHES):
                complexity += 1
            elif isinstance(n, ast.BoolOp):
                complexity += len(n.values) - 1
            elif isinstance(n, ast.Call):
                calls += 1
                callee = ast.unparse(n.func)
                first, dot, rest = callee.partition(".")
                callee = alias[first] + dot + rest if first in alias else callee
                env = callee in ("os.getenv", "os.environ.get", "getenv") and n.args and isinstance(n.args[0], ast.Constant)
                if env:
                    reads.add(str(n.args[0].value))
                    edges.append((str(n.args[0].value), "READS", n.lineno, "environment", "unresolved"))
                elif callee == "getattr" and len(n.args) > 1:
                    edges.append((str(getattr(n.args[1], "value", ast.unparse(n.args[1]))), "CALLS", n.lineno, "getattr", "dynamic"))
                else:
                    target = f"{owner}.{callee[5:]}" if callee.startswith("self.") and "." not in callee[5:] and owner else callee
                    edges.append((target, "CALLS", n.lineno, f"call {callee}", "unresolved"))
            elif isinstance(n, ast.Raise) and n.exc is not None:
                kind = ast.unparse(n.exc.func if isinstance(n.exc, ast.Call) else n.exc)
                raises.add(kind)
                edges.append((kind, "RAISES", n.lineno, "raise", "unresolved"))
            elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and owner:
                store = isinstance(n.ctx, (ast.Store, ast.Del))
                (writes if store else reads).add(n.attr)
                edges.append((f"{owner}.{n.attr}", "WRITES" if store else "READS", n.lineno, "attribute", "unresolved"))
            elif isinstance(n, ast.Constant) and isinstance(n.value, str) and _SQL.match(n.value):
                edges.append((self.sql(n, name, own), "EMBEDS_SQL", n.lineno, "string literal", "resolved"))
        for d in s.decorator_list:
            call = d.func if isinstance(d, ast.Call) else d
            verb = ast.unparse(call).split(".")[-1].lower()
            if verb in _ROUTES and isinstance(d, ast.Call) and d.args and isinstance(d.args[0], ast.Constant):
                reads.add(f"ROUTE:{'ANY' if verb == 'route' else verb.upper()}:{d.args[0].value}")
        found.node(
            name, "method" if prefix and owner else "function", f"{'async ' if isinstance(s, ast.AsyncFunctionDef) else ''}def {s.name}({', '.join(params)}){f' -> {returns}' if returns else ''}", s.lineno, s.end_lineno,
            self.source(s), story=(ast.get_docstring(s) or "").strip().split("\n")[0], complexity=complexity, calls=calls, params=params, returns=returns, reads=reads, writes=writes, raises=raises,
        )
        found.edge(own, scope, "DEFINED_IN", s.lineno, "def", "resolved")
        for dst, kind, line, how, sure in edges:
            found.edge(own, dst, kind, line, how, sure)
        if s.name == "__init__" and owner:
            for t in {n.attr: n for n in ast.walk(s) if isinstance(n, ast.Attribute) and isinstance(n.ctx, ast.Store) and isinstance(n.value, ast.Name) and n.value.id == "self"}.values():
                var = found.node(f"{owner}.{t.attr}", "variable", f"self.{t.attr}", t.lineno, t.end_lineno, t.attr)
                found.edge(var, scope, "DEFINED_IN", t.lineno, "attribute", "resolved")
        self.body([x for x in s.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], name + ".", own)

    def sql(self, n: ast.Constant, name: str, own: str) -> str:
        query = self.found.node(f"{name}.sql_{n.lineno}", "sql_query", " ".join(n.value.split())[:80], n.lineno, n.end_lineno, n.value)
        reads, writes = named_tables(n.value)
        for kind, tables in (("READS", reads), ("WRITES", writes)):
            for t in sorted(tables):
                self.found.edge(query, t, kind, n.lineno, "embedded sql")
        return query


_LINE = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)|^\s*(?:from\s+([.\w]+)\s+)?import\s+([\w., ]+)")


def _by_lines(found: Found, text: str) -> Found:
    lines = text.splitlines()
    module = found.node("<module>", "file", f"module {found.path}", 1, max(1, len(lines)), text)
    holder: list[tuple[int, str]] = []
    for i, line in enumerate(lines, 1):
        m = _LINE.match(line)
        if not m:
            continue
        if m[2]:
            depth = len(m[1].expandtabs(4))
            holder = [h for h in holder if h[0] < depth]
            name = ".".join([h[1] for h in holder] + [m[3]])
            own = found.node(name, "class" if m[2] == "class" else "method" if holder else "function", line.strip(), i, i, line)
            found.edge(own, found.id(".".join(h[1] for h in holder)) if holder else module, "DEFINED_IN", i, "line")
            holder.append((depth, m[3]))
        else:
            for one in m[5].split(","):
                part = one.split(" as ")[0].strip()
                if part:
                    found.edge(module, f"{m[4]}{'' if m[4].endswith('.') else '.'}{part}" if m[4] else part, "IMPORTS", i, "line")
    return found
