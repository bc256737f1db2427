"""SQL, shell, JSON, YAML, TypeScript and JavaScript, and line patterns for all other languages."""

from __future__ import annotations

import json
import re

from ..sources.parse import flatten
from .model import Found, named_tables

MAX_KEYS = 80


def sql(text: str, path: str) -> Found:
    """Statements up to their semicolons: CREATE TABLE makes tables with their columns, others queries with accesses."""
    found = Found(path, "sql")
    top = found.node("<file>", "file", f"sql {found.path}", 1, max(1, text.count("\n") + 1), text)
    at, n = 0, 0
    for body in re.findall(r"(?:'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/|[^;])+", text, re.DOTALL):
        start = text.count("\n", 0, at + len(body) - len(body.lstrip())) + 1
        at += len(body) + 1
        plain = re.sub(r"^(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", body, flags=re.DOTALL).strip()
        if not re.match(r"[A-Za-z]", plain):
            continue
        end, made = start + body.strip().count("\n"), re.match(r"create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(table|view|function)\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)", plain, re.IGNORECASE)
        if made and made[1].lower() != "function":
            inner = plain[plain.find("(") + 1 : plain.rfind(")")] if "(" in plain else ""
            words = [c.split()[0].strip('"`') for c in re.split(r",(?![^(]*\))", inner) if c.split()]
            own = found.node(made[2], "sql_table", f"CREATE {made[1].upper()} {made[2]}", start, end, plain, params=[w for w in words if w.upper() not in ("PRIMARY", "FOREIGN", "CONSTRAINT", "UNIQUE", "CHECK", "SELECT")])
        elif made:
            own = found.node(made[2], "function", f"CREATE FUNCTION {made[2]}", start, end, plain)
        else:
            n += 1
            own = found.node(f"query_{n}", "sql_query", " ".join(plain.split())[:80], start, end, plain)
        found.edge(own, top, "DEFINED_IN", start, "statement", "resolved", end)
        reads, writes = named_tables(plain)
        if altered := re.match(r"(?:alter\s+table(?:\s+if\s+exists)?(?:\s+only)?|create\s+(?:unique\s+)?index\s.*?\bon(?:\s+only)?|comment\s+on\s+table|drop\s+table(?:\s+if\s+exists)?)\s+[\"`]?([\w.]+)", plain, re.IGNORECASE | re.DOTALL):
            writes = writes | {altered[1]}
        if made:  # what a table refers to or is made from
            reads = (reads | set(re.findall(r"\breferences\s+[\"`]?([\w.]+)", plain, re.IGNORECASE))) - {made[2]}
        for kind, tables in (("READS", reads), ("WRITES", writes)):
            for t in sorted(tables):
                found.edge(own, t, kind, start, "sql", end=end)
    return found


def shell(text: str, path: str) -> Found:
    """Commands of a script by line and pipeline part. The variables of a command are those of the lines up to its own."""
    found = Found(path, "sh")
    top = found.node("<script>", "shell_script", f"script {found.path}", 1, max(1, text.count("\n") + 1), text)
    reads, writes = set(), set()
    for i, line in enumerate(text.split("\n"), 1):
        plain = re.sub(r"(^|\s)#.*$", "", line).strip()
        if not plain:
            continue
        reads |= set(re.findall(r"\$\{?([A-Z_][A-Z0-9_]*)", plain))
        writes |= set(re.findall(r"(?:^|;|export\s+)\s*([A-Z_][A-Z0-9_]*)=", plain))
        for k, part in enumerate(re.split(r"\|\|?|&&|;", plain)):
            words = re.sub(r"^(?:export\s+)?[A-Z_][A-Z0-9_]*=\S*\s*", "", part.strip()).split()
            if not words or words[0] in ("if", "then", "fi", "else", "do", "done", "for", "while", "case", "esac", "{", "}"):
                continue
            own = found.node(f"cmd_{i}_{k}", "command", part.strip()[:80], i, i, part, reads=reads, writes=writes)
            found.edge(own, top, "DEFINED_IN", i, "command", "resolved")
            for v in sorted(reads):
                found.edge(own, v, "READS", i, "environment")
            for v in sorted(writes):
                found.edge(own, v, "WRITES", i, "environment")
            target = next((w for w in words if re.search(r"\.(py|sh|sql|js|rb)$", w) and not w.startswith("-")), None)
            if target:
                found.edge(own, target, "RUNS_SCRIPT", i, "command")
    return found


def config(text: str, path: str, kind: str) -> Found:
    """Dotted keys of a JSON or YAML document; a JSON document with too many keys is one node with the first of them."""
    found = Found(path, kind)
    if kind == "json":
        doc = json.loads(text)
    else:
        import yaml

        doc = yaml.safe_load(text)
    keys = list(flatten(doc))
    many = kind == "json" and len(keys) > MAX_KEYS
    top = found.node("<file>", "file", f"{kind} {found.path}", 1, max(1, text.count("\n") + 1), text, params=[k for k, _ in keys[:20]] if many else [])
    for key, value in [] if many else keys:
        shown = value if isinstance(value, str) else json.dumps(value, default=str, sort_keys=True)
        line = next((i for i, x in enumerate(text.split("\n"), 1) if re.search(rf"\b{re.escape(re.split(r'[.\[]', key)[-1].rstrip(']'))}\b", x)), 1)
        own = found.node(key, f"{kind}_config", f"{key} = {shown[:60]}", line, line, shown)
        found.edge(own, top, "DEFINED_IN", line, "key", "resolved")
        if kind == "yaml" and isinstance(value, str) and value.endswith((".sh", ".py")):
            found.edge(own, value.split()[-1], "RUNS_SCRIPT", line, "value")
    return found


def blanked(text: str) -> str:
    """Comments and the insides of strings as blanks, all places kept."""
    keep = lambda m: m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1] if m[0][0] in "\"'`" else re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", keep, text, flags=re.DOTALL)


def _close(text: str, at: int) -> int:
    """The place of the brace that closes the one at a place; the end where none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return len(text) - 1


_TS = re.compile(
    r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?P<what>class|interface|type|enum)\s+(?P<name>[A-Za-z_$][\w$]*)(?P<rest>[^{=;]*)"
    r"|(?:async\s+)?function\s*\*?\s+(?P<fn>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\((?P<args>[^)]*)\)"
    r"|\b(?:const|let|var)\s+(?P<arrow>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:\w+\(\s*)?(?:async\s*)?(?:\((?P<aargs>[^)]*)\)|(?P<one>[A-Za-z_$][\w$]*))\s*(?::\s*[^=]+)?=>"
    r"|\bconst\s+(?P<const>[A-Z][A-Z0-9_]+)\s*="
)
_METHOD = re.compile(r"^\s*(?:public |private |protected |static |async |readonly |get |set )*(?P<m>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\((?P<a>[^)]*)\)\s*(?::\s*[^{]+)?\{", re.MULTILINE)
_HTTP = re.compile(r"\b(?:fetch|(?:axios|apiClient)(?:\.(get|post|put|delete|patch))?)\s*\(\s*['\"`]([^'\"`]+)['\"`]", re.IGNORECASE)
_CLIENT = re.compile(r"\b(?:fetch|axios(?:\.(?:get|post|put|delete|patch))?)\s*\(")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "await", "super", "constructor"}


def typescript(text: str, path: str) -> Found:
    """Imports, types, classes with their methods, functions, arrow functions and constants. Containers point at what
    they hold, unlike in other languages."""
    found = Found(path, "ts")
    plain = blanked(text)
    line = lambda at: text.count("\n", 0, at) + 1
    top = found.node("<module>", "file", f"module {found.path}", 1, line(len(text)), text)
    for m in re.finditer(r"\bimport\s[^;'\"]*?from\s*['\"]([^'\"]+)['\"]|\bimport\s*\(?\s*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]", text):
        found.edge(top, m[1] or m[2] or m[3], "IMPORTS", line(m.start()), "import")

    def calls(own: str, a: int, b: int) -> int:
        n = 0
        for c in re.finditer(r"\b([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(", plain[a:b]):
            if c[1].split(".")[0] not in _WORDS:
                n += 1
                found.edge(own, c[1], "CALLS", line(a + c.start()), "call")
        return n

    def routine(name: str, kind: str, holder: str, at: int, brace: int, args: str) -> None:
        end = _close(plain, brace) if brace >= 0 else plain.find("\n", at) if plain.find("\n", at) > 0 else len(plain) - 1
        own = found.id(name)
        n = calls(own, brace if brace >= 0 else at, end)
        http = {f"HTTP:{m[1].upper()}:{m[2]}" if m[1] else f"HTTP:{m[2]}" for m in _HTTP.finditer(text, at, end + 1)}
        branches = len(re.findall(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.:?])", plain[at : end + 1]))
        found.node(name, kind, text[at:].split("\n")[0].strip()[:80], line(at), line(end), text[at : end + 1], complexity=1 + branches, calls=n, params=[a.strip() for a in args.split(",") if a.strip()], reads=http)
        found.edge(holder, own, "DEFINED_IN", line(at), kind, "resolved")
        routines.append((found.nodes[-1], at, end + 1))

    inside, routines = 0, []
    for m in _TS.finditer(plain):
        if m["what"]:
            brace = plain.find("{", m.end() - 1) if m["what"] != "type" else -1
            end = _close(plain, brace) if brace >= 0 else plain.find("\n", m.end())
            own = found.node(m["name"], {"class": "class", "interface": "interface"}.get(m["what"], "type"), text[m.start() :].split("\n")[0].strip()[:80], line(m.start()), line(max(end, m.start())), text[m.start() : end + 1])
            found.edge(top, own, "DEFINED_IN", line(m.start()), m["what"], "resolved")
            for word, kind in (("extends", "INHERITS"), ("implements", "IMPLEMENTS")):
                for base in re.findall(rf"\b{word}\s+([\w$., <>]+?)(?=\bimplements\b|\bextends\b|$)", m["rest"].strip()):
                    for b in re.sub(r"<[^>]*>", "", base).split(","):
                        if b.strip():
                            found.edge(own, b.strip(), kind, line(m.start()), word)
            if m["what"] == "class" and brace >= 0:
                inside = end
                for k in _METHOD.finditer(plain, brace + 1, end):
                    if k["m"] not in _WORDS - {"constructor"}:
                        routine(f"{m['name']}.{k['m']}", "method", own, k.start("m"), k.end() - 1, k["a"])
        elif m["fn"]:
            routine(m["fn"], "function", top, m.start(), plain.find("{", m.end()), m["args"])
        elif m["arrow"] and m.start() > inside:
            body = re.compile(r"\s*\{").match(plain, m.end())
            routine(m["arrow"], "function", top, m.start(), body.end() - 1 if body else -1, m["aargs"] or m["one"] or "")
        elif m["const"]:
            own = found.node(m["const"], "variable", text[m.start() :].split("\n")[0].strip()[:80], line(m.start()), line(m.start()))
            found.edge(top, own, "DEFINED_IN", line(m.start()), "const", "resolved")
    _through_wrappers(text, routines)
    return found


def _through_wrappers(text: str, routines: list[tuple[dict, int, int]]) -> None:
    """URLs that are given to functions which call an HTTP client are calls of the function that gives them."""
    clients = [r for r in routines if _CLIENT.search(text, r[1], r[2])]
    names = sorted({n["id"].split("::")[-1].split(".")[-1] for n, _, _ in clients}, key=lambda x: (-len(x), x))
    for n, at, end in routines:
        if names:
            given = re.compile(rf"\b(?:{'|'.join(map(re.escape, names))})\s*(?:<[^>]*>)?\s*\(\s*['\"`]([^'\"`]+)").finditer(text, at, end)
            known = {x.split(":")[-1] for x in n["reads"]}
            urls = {m[1] for m in given if re.match(r"/|http", m[1]) or "/api" in m[1].lower()}
            n["reads"] = sorted({*n["reads"], *(f"HTTP:{u}" for u in urls - known)})
        if any(n is c for c, _, _ in clients) and not any(x.startswith("HTTP:") for x in n["reads"]):
            n["reads"] = sorted([*n["reads"], "HTTP:wrapper"])


_NAME = r"([A-Za-z_][\w]*)"
#: (lines that begin classes, functions, imports) by language; group 1 of each is the name.
PATTERNS = {
    "go": (rf"^type\s+{_NAME}\s+(?:struct|interface)", rf"^func\s+(?:\([^)]*\)\s*)?{_NAME}\s*\(", r'^\s*(?:import\s+)?"([\w./-]+)"$'),
    "rust": (rf"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+{_NAME}", rf"^\s*(?:pub\s+)?(?:async\s+)?fn\s+{_NAME}", r"^\s*use\s+([\w:]+)"),
    "java": (rf"^\s*(?:\w+\s+)*(?:class|interface|enum|record)\s+{_NAME}", rf"^\s+(?:public|private|protected|static|final|\s)+[\w<>\[\]]+\s+{_NAME}\s*\([^;]*\{{?$", r"^import\s+(?:static\s+)?([\w.]+)"),
    "ruby": (rf"^\s*(?:class|module)\s+{_NAME}", r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!]?)", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)"),
    "c": (rf"^\s*(?:typedef\s+)?(?:struct|enum|union|class)\s+{_NAME}", rf"^[A-Za-z_][\w\s*<>:]*?\b{_NAME}\s*\([^;]*\)\s*\{{?$", r"^\s*#\s*include\s+[<\"]([^>\"]+)"),
    "swift": (rf"^\s*(?:\w+\s+)*(?:class|struct|protocol|enum|object|trait|interface)\s+{_NAME}", rf"^\s*(?:\w+\s+)*(?:func|fun|def)\s+{_NAME}", r"^\s*import\s+([\w.]+)"),
    "php": (rf"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+{_NAME}", rf"^\s*(?:\w+\s+)*function\s+{_NAME}", r"^\s*(?:use|require_once|include)\s+['\"]?([\w\\./]+)"),
    "lua": (rf"^{_NAME}\s*=\s*\{{\}}", r"^\s*(?:local\s+)?function\s+([\w.:]+)", r"require\s*\(?['\"]([^'\"]+)"),
    "elixir": (r"^\s*(?:defmodule|-module\()\s*([\w.]+)", r"^\s*(?:defp?\s+)?([a-z_]\w*)\s*\([^)]*\)\s*(?:do|->)", r"^\s*(?:import|alias|use|-include\()\s*\"?([\w./]+)"),
    "powershell": (rf"^\s*class\s+{_NAME}", r"^\s*function\s+([\w-]+)", r"^\s*Import-Module\s+([\w./-]+)"),
    "julia": (rf"^\s*(?:mutable\s+)?(?:struct|module)\s+{_NAME}", r"^\s*function\s+([\w.!]+)", r"^\s*(?:using|import)\s+([\w.]+)"),
    "fortran": (r"(?i)^\s*(?:module|type)\s+(\w+)", r"(?i)^\s*(?:\w+\s+)*(?:subroutine|function)\s+(\w+)", r"(?i)^\s*use\s+(\w+)"),
    "verilog": (rf"^\s*(?:module|interface|class)\s+{_NAME}", rf"^\s*(?:function|task)\s+(?:\w+\s+)*{_NAME}\s*[(;]", r"^\s*`include\s+\"([^\"]+)"),
    "terraform": (r"^\s*(?:resource|data)\s+\"[^\"]+\"\s+\"([^\"]+)\"", r"^\s*(?:module|variable|output)\s+\"([^\"]+)\"", r"^\s*source\s*=\s*\"([^\"]+)\""),
    "markdown": (r"^#\s+(.+?)\s*$", r"^##+\s+(.+?)\s*$", r"\]\((?!https?:)([^)#\s]+)"),
}
SAME_AS = {"cpp": "c", "csharp": "java", "kotlin": "swift", "scala": "swift", "zig": "rust", "erlang": "elixir", "objc": "c", "dart": "java", "solidity": "java", "groovy": "java"}


# Languages whose blocks are closed by a word or by what stands less far right; in the others braces close them.
_WORD_BLOCKS = {"ruby", "lua", "elixir", "erlang", "julia", "fortran", "verilog", "markdown"}
#: What a class line says of its bases.
_BASES = re.compile(r"\b(?:extends|implements|inherits|with)\s+([\w.:<>, ]+?)(?=\s*(?:\b(?:extends|implements|with|where)\b|[{(]|$))|(?:class|struct|interface|protocol|object|trait|contract)\s+\w+(?:<[^>]*>)?(?:\([^)]*\))?\s*(?::|<(?!<))\s*([\w.:<>, ()]+?)(?=\s*(?:[{]|where\b|$))|\bis\s+([\w, ]+?)(?=\s*\{)")
_NO_CALL = _WORDS | {"elif", "unless", "until", "match", "when", "loop", "fn", "func", "fun", "def", "end", "do", "else", "sizeof", "print", "println", "let", "var", "and", "or", "not", "in", "foreach", "assert", "defer", "go", "select", "using", "lock", "use", "mod", "pub"}


def _block_end(lines: list[str], i: int, by_words: bool) -> int:
    """The last line (from 1) of the block that line i (from 0) opens: where its braces close, or before the next line that
    stands no further right, a closing word included; the line itself where it opens none."""
    depth, opened = 0, False
    if not by_words:
        for k in range(i, len(lines)):
            plain = re.sub(r"//.*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", lines[k])
            depth += plain.count("{") - plain.count("}")
            opened = opened or "{" in plain
            if opened and depth <= 0:
                return k + 1
            if not opened and (k > i + 1 or plain.rstrip().endswith(";")):
                return i + 1
        return len(lines) if opened else i + 1
    own = len(lines[i]) - len(lines[i].lstrip())
    for k in range(i + 1, len(lines)):
        if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= own:
            return k + 1 if re.match(r"\s*end\b|\s*\}", lines[k]) else k
    return len(lines)


def _names_of(bases: str) -> list[str]:
    return [b for b in (re.sub(r"<.*?>|\([^)]*\)|\b(?:public|private|protected|virtual)\b", "", x).strip() for x in bases.split(",")) if re.fullmatch(r"[\w.:]+", b)]


def by_lines(text: str, path: str, lang: str) -> Found:
    """Classes with their bases, functions with the calls in their blocks, and imports, by the patterns of a language."""
    found = Found(path, lang)
    classes, functions, imports = (re.compile(p) for p in PATTERNS[SAME_AS.get(lang, lang)])
    top = found.node("<module>", "file", f"{lang} {found.path}", 1, max(1, text.count("\n") + 1), text)
    lines, by_words, prose = text.split("\n"), SAME_AS.get(lang, lang) in _WORD_BLOCKS or lang in _WORD_BLOCKS, lang == "markdown"
    for i, line in enumerate(lines, 1):
        for kind, pattern in (("class", classes), ("function", functions)):
            if m := pattern.search(line):
                end = i if prose else _block_end(lines, i - 1, by_words)
                body = "\n".join(lines[i - 1 : end])
                made = [] if kind == "class" or prose else [(k, c[1]) for k, x in enumerate(lines[i:end], i + 1) for c in re.finditer(r"\b([A-Za-z_][\w]*(?:(?:\.|::|->)[A-Za-z_]\w*)*[!?]?)\s*\(", re.sub(r"//.*|#.*|\"(?:\\.|[^\"\\])*\"", "", x)) if c[1] not in _NO_CALL]
                own = found.node(m[1], kind, line.strip()[:80], i, end, body, calls=len(made))
                found.edge(own, top, "DEFINED_IN", i, "line", "resolved", end)
                for k, callee in made:
                    found.edge(own, callee.replace("->", ".").replace("::", "."), "CALLS", k, "line")
                if kind == "class" and not prose:
                    for b in _BASES.finditer(line.split("//")[0]):
                        for base in _names_of(b[1] or b[2] or b[3] or ""):
                            found.edge(own, base, "INHERITS", i, "line")
                break
        else:
            if m := imports.search(line):
                found.edge(top, m[1], "IMPORTS", i, "line")
    return found
