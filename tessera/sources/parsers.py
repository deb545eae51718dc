"""Source text to symbols, edges, imports and parameters, as one table-valued pass over files.

Python is read with its own syntax tree; the other languages by definition patterns and matching braces. Framework
facts (routes, tests, environment reads, models, requests) come from rule tables that hold for any of them.
"""

from __future__ import annotations

import ast
import bisect
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "path string, record string, kind string, name string, qname string, parent string, start_line int, end_line int, signature string, docstring string, "
    "dst_name string, confidence double, metadata_json string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KEYWORDS = frozenset("if for while switch catch return function typeof new await super this constructor match when fn func def class elif else do try throw sizeof using lock foreach fixed print in is not and or".split())
LINE = re.compile("\n")


class Extract:
    """Rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.text = path, text
        self.module = re.sub(r"\.[A-Za-z0-9]+$", "", path).replace("/", ".")
        self.breaks = [m.start() for m in LINE.finditer(text)]
        self.rows: list[dict] = []
        self.spans: list[tuple[int, int, str]] = []
        self.seen: set[tuple] = set()

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def symbol(self, kind: str, name: str, start: int, end: int, *, parent: str | None = None, signature: str = "", docstring: str = "", qname: str | None = None, **meta) -> str:
        qname = qname or f"{parent or self.module}.{name}"
        self.rows.append(dict(record="symbol", kind=kind, name=name, qname=qname, parent=parent or self.module, start_line=start, end_line=end, signature=signature, docstring=docstring, metadata_json=json.dumps(meta, sort_keys=True)))
        if kind in ("function", "method", "constructor", "component", "test_block"):
            self.spans.append((start, end, qname))
        return qname

    def edge(self, kind: str, src: str, dst: str, line: int, confidence: float, **meta) -> None:
        if (kind, src, dst) not in self.seen:
            self.seen.add((kind, src, dst))
            self.rows.append(dict(record="edge", kind=kind, qname=src, dst_name=dst, start_line=line, end_line=line, confidence=confidence, metadata_json=json.dumps(meta, sort_keys=True)))

    def binding(self, local: str, imported: str, module: str, line: int) -> None:
        self.rows.append(dict(record="import", kind="named", name=local, qname=self.module, dst_name=imported, start_line=line, end_line=line, confidence=0.8, metadata_json=json.dumps({"source_module": module})))
        self.edge("IMPORTS", self.module, f"{module}.{imported}" if imported not in ("", "*", "default") else module, line, 0.8)

    def parameter(self, owner: str, position: int, name: str, declared: str, confidence: float) -> None:
        self.rows.append(dict(record="parameter", kind=declared, name=name, qname=owner, start_line=position, end_line=position, confidence=confidence, metadata_json="{}"))

    def enclosing(self, line: int) -> str:
        """The smallest function-like symbol around a line, else the module."""
        best = min(((e - s, q) for s, e, q in self.spans if s <= line <= e), default=None)
        return best[1] if best else self.module


def matching_brace(text: str, opening: int) -> int:
    """The offset of the brace that closes the one at ``opening``, past strings and comments; the end if none does."""
    scan = re.compile(r"""[{}]|//[^\n]*|/\*.*?\*/|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`""", re.S)
    depth = 0
    for m in scan.finditer(text, opening):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth and m.group() == "}":
            return m.start()
    return len(text)


def split_parameters(text: str) -> list[str]:
    """Parameter texts, cut at commas outside brackets."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>")
        if c == "," and depth == 0:
            out.append(text[last:i])
            last = i + 1
    return [x.strip() for x in [*out, text[last:]] if x.strip()]


def join_route(prefix: str, path: str) -> str:
    """A route's path below the prefix of its class or router: one slash between the parts, none at the end."""
    return "/" + "/".join(p for part in (prefix, path) for p in part.strip("/").split("/") if p)


# ---- Python


def _python(x: Extract) -> None:
    tree = ast.parse(x.text)
    constants: set[str] = set()
    fixtures: set[str] = set()

    def name_of(node: ast.AST) -> str:
        if isinstance(node, ast.Attribute):
            return f"{name_of(node.value)}.{node.attr}".strip(".")
        return node.id if isinstance(node, ast.Name) else name_of(node.func) if isinstance(node, ast.Call) else ""

    def visit(node: ast.AST, parent: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                q = x.symbol("class", child.name, child.lineno, child.end_lineno, parent=parent, signature=f"class {child.name}", docstring=ast.get_docstring(child) or "")
                for base in child.bases:
                    if n := name_of(base):
                        x.edge("EXTENDS", q, n.rsplit(".", 1)[-1], child.lineno, 0.8)
                        if n.rsplit(".", 1)[-1] in ("BaseModel", "SQLModel", "Base", "Model"):
                            table = next((a.value.value for a in child.body if isinstance(a, ast.Assign) and isinstance(a.value, ast.Constant) and getattr(a.targets[0], "id", "") == "__tablename__"), None)
                            meta = {"table_name": table} if table else {}
                            x.symbol("schema" if n.endswith("BaseModel") else "model", child.name, child.lineno, child.end_lineno, qname=f"{'schema' if n.endswith('BaseModel') else 'orm'}::{child.name}", **meta)
                visit(child, q, True)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                head = "async def" if isinstance(child, ast.AsyncFunctionDef) else "def"
                signature = f"{head} {child.name}({ast.unparse(child.args)})" + (f" -> {ast.unparse(child.returns)}" if child.returns else "")
                q = x.symbol("method" if in_class else "function", child.name, child.lineno, child.end_lineno, parent=parent, signature=signature, docstring=ast.get_docstring(child) or "")
                arguments = [*child.args.posonlyargs, *child.args.args, *([child.args.vararg] if child.args.vararg else []), *child.args.kwonlyargs, *([child.args.kwarg] if child.args.kwarg else [])]
                for i, a in enumerate([a for a in arguments if a.arg not in ("self", "cls")]):
                    x.parameter(q, i, a.arg, ast.unparse(a.annotation) if a.annotation else "", 0.78 if a.annotation else 0.64)
                for d in child.decorator_list:
                    target = name_of(d)
                    verb = target.rsplit(".", 1)[-1]
                    if isinstance(d, ast.Call) and verb in ("get", "post", "put", "patch", "delete", "route") and d.args and isinstance(d.args[0], ast.Constant):
                        method = "ANY" if verb == "route" else verb.upper()
                        r = x.symbol("route", f"{method} {d.args[0].value}", child.lineno, child.lineno, qname=f"{'flask' if verb == 'route' else 'fastapi'}::{method} {d.args[0].value}", http_method=method, path=str(d.args[0].value))
                        x.edge("ROUTES_TO", r, q, child.lineno, 0.95)
                        x.edge("ROUTE_HANDLED_BY", r, q, child.lineno, 0.95 if verb != "route" else 0.9)
                    elif target.endswith("fixture"):
                        x.symbol("fixture", child.name, child.lineno, child.end_lineno, qname=f"pytest::{x.path}::{child.name}")
                        fixtures.add(child.name)
                calls = {name_of(c.func).rsplit(".", 1)[-1]: c.lineno for c in ast.walk(child) if isinstance(c, ast.Call) and name_of(c.func)}
                for n, line in sorted(calls.items()):
                    if not n.startswith("_"):
                        x.edge("CALLS", q, n, line, 0.7)
                if child.name.startswith("test_"):
                    t = x.symbol("test_block", child.name, child.lineno, child.end_lineno, qname=f"pytest::{x.path}::{child.name}")
                    x.edge("TESTS", q, child.name.removeprefix("test_"), child.lineno, 0.5)
                    for n, line in sorted(calls.items()):
                        x.edge("TESTS_SYMBOL", t, n, line, 0.5)
                    for a in arguments:
                        if a.arg in fixtures:
                            x.edge("USES_FIXTURE", t, f"pytest::{x.path}::{a.arg}", child.lineno, 0.8)
                visit(child, q, False)
            elif isinstance(child, ast.Import):
                for a in child.names:
                    x.binding(a.asname or a.name.split(".")[0], "", a.name, child.lineno)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                for a in child.names:
                    x.binding(a.asname or a.name, a.name, module, child.lineno) if a.name != "*" else x.edge("IMPORTS", x.module, module, child.lineno, 0.8)
            elif isinstance(child, (ast.Assign, ast.AnnAssign)) and parent is None:
                for t in child.targets if isinstance(child, ast.Assign) else [child.target]:
                    if isinstance(t, ast.Name) and re.fullmatch(r"[A-Z][A-Z0-9_]*", t.id):
                        x.symbol("constant", t.id, child.lineno, child.end_lineno)
                        constants.add(t.id)
                    if isinstance(t, ast.Name) and t.id == "urlpatterns" and isinstance(child.value, ast.List):
                        for call in (c for c in child.value.elts if isinstance(c, ast.Call) and name_of(c.func) in ("path", "re_path", "url") and len(c.args) > 1 and isinstance(c.args[0], ast.Constant)):
                            place = join_route("", str(call.args[0].value))
                            r = x.symbol("route", f"ANY {place}", call.lineno, call.lineno, qname=f"django::ANY {place}", http_method="ANY", path=place)
                            handler = name_of(call.args[1]).removesuffix(".as_view").rsplit(".", 1)[-1]
                            x.edge("ROUTE_HANDLED_BY", r, handler, call.lineno, 0.9)
                visit(child, parent, in_class)
            else:
                visit(child, parent, in_class)

    visit(tree, None, False)
    # constants of the file that its functions read, each once for a function
    for node in ast.walk(tree) if constants else ():
        if isinstance(node, ast.Name) and node.id in constants and isinstance(node.ctx, ast.Load) and (src := x.enclosing(node.lineno)) != x.module:
            x.edge("READS_CONSTANT", src, f"{x.module}.{node.id}", node.lineno, 0.85)


# ---- languages with braces

GENERIC = r"(?:<(?:[^<>]|<[^<>]*>)*>)"
# Definition patterns by language: kind, pattern with the groups name and, where there are any, params, base,
# bases (a list) or trait. A pattern that does not end at a brace ends with its line.
DEFINITIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [
        ("class", r"\bclass\s+(?P<name>\w+)G?(?:\s+extends\s+(?P<base>[\w.]+)G?)?(?:\s+implements\s+(?P<impl>[^{]+?))?\s*\{"),
        ("function", r"\bfunction\s*\*?\s*(?P<name>\w+)\s*G?\((?P<params>[^)]*)\)[^{;]*\{"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?G?\((?P<params>[^)]*)\)\s*(?::[^=]+)?=>\s*\{"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:<[^>\n]*>\s*)?(?:\((?P<params>[^)]*)\)|\w+)\s*(?::[^=\n]+)?=>(?!\s*\{)"),
        ("function", r"\b(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s+)?function\s*\*?\s*\w*\s*\((?P<params>[^)]*)\)[^{;]*\{"),
        ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?P<name>[A-Za-z_$]\w*)\s*G?\((?P<params>[^)]*)\)\s*(?::[^{;=]+)?\{"),
        ("interface", r"\binterface\s+(?P<name>\w+)[^{;]*\{"), ("enum", r"\benum\s+(?P<name>\w+)\s*\{"), ("type_alias", r"(?m)^\s*(?:export\s+)?type\s+(?P<name>\w+)\s*G?\s*="),
    ],
    "java": [
        ("class", r"\b(?:class|record)\s+(?P<name>\w+)G?(?:\s*\([^)]*\))?(?:\s+extends\s+(?P<base>[\w.]+)G?)?(?:\s+implements\s+(?P<impl>[^{]+?))?\s*\{"), ("interface", r"\b(?<!@)interface\s+(?P<name>\w+)[^{;]*\{"),
        ("enum", r"\benum\s+(?P<name>\w+)[^{;]*\{"),
        ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|default)\s+)*G?\s*[\w<>\[\],.? ]+?\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws [\w., ]+)?\{"),
        ("method", r"(?m)^[ \t]+(?:public|protected|private)\s+(?P<name>[A-Z]\w*)\s*\((?P<params>[^)]*)\)\s*(?:throws [\w., ]+)?\{"),
        ("constant", r"\bstatic\s+final\s+[\w<>\[\],.? ]+?\s+(?P<name>[A-Z][A-Z0-9_]*)\s*="),
    ],
    "go": [
        ("struct", r"\btype\s+(?P<name>\w+)\s+struct\s*\{"), ("interface", r"\btype\s+(?P<name>\w+)\s+interface\s*\{"),
        ("method", r"(?m)^func\s+\(\s*\w+\s+\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{]*\{"), ("function", r"(?m)^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\((?P<params>[^)]*)\)[^{\n]*\{"),
        ("constant", r"(?m)^const\s+(?P<name>\w+)\b"), ("constant", r"(?m)(?<=^const \()\s*\n[ \t]+(?P<name>\w+)\b"), ("variable", r"(?m)^var\s+(?P<name>\w+)\b"),
    ],
    "csharp": [
        ("class", r"\b(?:class|struct|record)\s+(?P<name>\w+)G?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[^{;]+?))?\s*(?:\bwhere\b[^{;]*)?\{"), ("interface", r"\binterface\s+(?P<name>\w+)[^{;]*\{"), ("enum", r"\benum\s+(?P<name>\w+)[^{;]*\{"),
        ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async|sealed|abstract)\s+)+[\w<>\[\],.? ]+?\s+(?P<name>\w+)\s*G?\((?P<params>[^)]*)\)\s*\{"),
        ("method", r"(?m)^[ \t]+(?:(?:public|private|protected|internal|static|virtual|override|async)\s+)+[\w<>\[\],.? ]+?\s+(?P<name>\w+)\s*G?\((?P<params>[^)]*)\)\s*=>"),
        ("constant", r"\bconst\s+[\w<>\[\]?.]+\s+(?P<name>\w+)\s*="), ("property", r"(?m)^[ \t]+(?:(?:public|protected|internal|private|static|virtual|override|required)\s+)+[\w<>\[\],.?]+\s+(?P<name>[A-Z]\w*)\s*\{\s*(?=(?:get|set|init)\b)"),
    ],
    "rust": [
        ("struct", r"\bstruct\s+(?P<name>\w+)[^{;]*\{"), ("enum", r"\benum\s+(?P<name>\w+)[^{;]*\{"), ("trait", r"\btrait\s+(?P<name>\w+)[^{;]*\{"), ("module", r"(?m)^\s*(?:pub\s+)?mod\s+(?P<name>\w+)\s*\{"),
        ("impl", r"\bimplG?\s+(?:(?P<trait>[\w:]+)G?\s+for\s+)?(?P<name>\w+)[^{;]*\{"), ("function", r"\bfn\s+(?P<name>\w+)\s*G?\((?P<params>[^)]*)\)[^{;]*\{"),
        ("constant", r"\b(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z][A-Z0-9_]*)\s*:"),
    ],
    "kotlin": [
        ("class", r"\b(?:class|object)\s+(?P<name>\w+)G?(?:\s*\([^)]*\))?(?:\s*:\s*(?P<bases>[^{\n]+?))?\s*\{"), ("class", r"\bdata\s+class\s+(?P<name>\w+)\s*\([^)]*\)(?!\s*[:{])"), ("interface", r"\binterface\s+(?P<name>\w+)[^{\n]*\{"),
        ("function", r"\bfun\s+G?\s*(?:[\w.]+\.)?(?P<name>\w+|`[^`\n]+`)\s*\((?P<params>[^)]*)\)[^{\n=]*\{"), ("function", r"\bfun\s+G?\s*(?:[\w.]+\.)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{\n=]*=(?!=)"),
        ("constant", r"\bconst\s+val\s+(?P<name>\w+)\b"), ("property", r"(?m)^[ \t]*(?:(?:private|internal|public|protected|override|lateinit)\s+)*va[lr]\s+(?P<name>\w+)\b"),
    ],
}
DEFINITIONS = {language: [(kind, pattern.replace("G?", GENERIC + "?")) for kind, pattern in rules] for language, rules in DEFINITIONS.items()}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"]
OWNERS = ("class", "interface", "struct", "trait", "enum", "module", "impl")
CALLABLE = ("function", "method", "constructor", "test_block")
# Import patterns by language: module and, where there is one, what is imported.
IMPORTS = {
    "javascript": r"""import\s+(?:(?P<what>[\w*{}\s,$]+?)\s+from\s+)?['"](?P<module>[^'"]+)['"]|(?:\b(?:const|let|var)\s+(?P<cjs>\{[^}]*\}|\w+)\s*=\s*)?\brequire\(\s*['"](?P<req>[^'"]+)['"]\s*\)""", "java": r"(?m)^import\s+(?:static\s+)?(?P<module>[\w.]+?)\.(?P<what>\w+|\*);",
    "go": r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"(?P<module>[\w./\-]+)"\s*$', "csharp": r"(?m)^using\s+(?:static\s+)?(?P<module>[\w.]+);", "rust": r"(?m)^\s*(?:pub\s+)?use\s+(?P<module>[\w:]+?)::(?P<what>\w+|\*|\{[^}]*\});",
    "kotlin": r"(?m)^import\s+(?P<module>[\w.]+?)\.(?P<what>\w+|\*)\s*$",
}
IMPORTS["typescript"] = IMPORTS["javascript"]
# What stands before a test, by language.
TEST_MARKS = {
    "java": r"@(?:Test|ParameterizedTest|RepeatedTest)\b", "kotlin": r"@(?:Test|ParameterizedTest)\b", "csharp": r"\[(?:Fact|Theory|Test|TestCase|TestMethod)\b", "rust": r"#\[(?:\w+::)?test\b",
}
MAPPING = re.compile(r"@(?P<verb>Get|Post|Put|Patch|Delete|Request)Mapping\b(?:\((?P<args>[^)]*)\))?")
HTTP_ATTRIBUTE = re.compile(r"""\[Http(?P<verb>Get|Post|Put|Patch|Delete)(?:\(\s*"(?P<path>[^"]*)"[^)]*\))?\s*\]""")
CLASS_ROUTE = re.compile(r"""\[Route\(\s*"(?P<path>[^"]*)"\s*\)\]""")
CALL_CONFIDENCE = {"javascript": 0.5, "typescript": 0.5}
CALL = re.compile(r"(?<![\w.])(?:[\w$]+\.)*(?P<name>[A-Za-z_$]\w*)\s*\(")


def _head(text: str, at: int) -> str:
    """The annotations, attributes and comments on the lines before a definition, and what stands before it on its line."""
    begin = text.rfind("\n", 0, at) + 1
    while begin:
        last = text.rfind("\n", 0, begin - 1) + 1
        if not re.match(r"\s*(?:@|\[|#\[|//|/?\*)", text[last:begin]):
            break
        begin = last
    return text[begin:at]


def _bases(x: Extract, language: str, q: str, groups: dict, line: int) -> None:
    """Edges to what a type extends and implements."""
    if groups.get("base"):
        x.edge("EXTENDS", q, groups["base"].rsplit(".", 1)[-1], line, 0.8)
    for name in re.findall(r"[\w.]+", re.sub(r"<[^{]*?>", "", groups.get("impl") or "")):
        x.edge("IMPLEMENTS", q, name.rsplit(".", 1)[-1], line, 0.8)
    for i, part in enumerate(split_parameters(groups.get("bases") or "")):
        name = re.match(r"[\w.]+", part)
        if name:
            last = name.group().rsplit(".", 1)[-1]
            # a first base is a class unless it is called like an interface; in Kotlin a class is constructed
            is_class = "(" in part if language == "kotlin" else i == 0 and not re.match(r"I[A-Z]", last)
            x.edge("EXTENDS" if is_class else "IMPLEMENTS", q, last, line, 0.8)


def _annotated_route(x: Extract, head: str, prefix: str, q: str, line: int) -> None:
    """The route that an annotation or attribute before a method gives, below the prefix of its class."""
    for m in MAPPING.finditer(head):
        args = m.group("args") or ""
        path = re.search(r"""(?:^\s*|\b(?:value|path)\s*=\s*)\{?\s*"([^"]*)\"""", args)
        verb = re.search(r"RequestMethod\.(\w+)", args)
        method = (verb.group(1) if verb else "ANY") if m.group("verb") == "Request" else m.group("verb").upper()
        _route(x, method, join_route(prefix, path.group(1) if path else ""), q, line)
    for m in HTTP_ATTRIBUTE.finditer(head):
        _route(x, m.group("verb").upper(), join_route(prefix, m.group("path") or ""), q, line)


def _route(x: Extract, method: str, path: str, handler: str, line: int, confidence: float = 0.9) -> None:
    r = x.symbol("route", f"{method} {path}", line, line, qname=f"route::{method} {path}", http_method=method, path=path)
    x.edge("ROUTES_TO", r, handler, line, confidence)


def _class_prefix(head: str, name: str) -> str:
    """The path that the routes of a class begin with."""
    if m := MAPPING.search(head):
        path = re.search(r'"([^"]*)"', m.group("args") or "")
        return path.group(1) if path else ""
    if m := CLASS_ROUTE.search(head):
        return m.group("path").replace("[controller]", name.removesuffix("Controller").lower())
    return ""


def _braces(x: Extract, language: str) -> None:
    owners: list[tuple[int, int, str, str]] = []
    found = []
    for kind, pattern in DEFINITIONS[language]:
        for m in re.finditer(pattern, x.text):
            if m.group("name") not in KEYWORDS:
                found.append((m.start("name"), kind, m))
    taken: set[int] = set()
    functions: dict[str, str] = {}
    calls: list[tuple[str, str, int]] = []
    tests: set[str] = set()
    for at, kind, m in sorted(found, key=lambda f: f[0]):
        if at in taken:
            continue
        taken.add(at)
        groups = m.groupdict()
        # a pattern that ends at a brace spans what it encloses, one that does not spans its line
        end = matching_brace(x.text, m.end() - 1) if m.group().rstrip().endswith("{") else x.text.find("\n", m.end())
        end = len(x.text) if end < 0 else end
        inside = [(q, prefix) for s, e, q, prefix in owners if s < at < e]
        parent = f"{x.module}.{groups['owner']}" if groups.get("owner") else inside[-1][0] if inside else None
        name, line = m.group("name").strip("`"), x.line(at)
        head = _head(x.text, at)
        if kind == "impl":
            owners.append((at, end, f"{x.module}.{name}", ""))
            if groups.get("trait"):
                x.edge("IMPLEMENTS", f"{x.module}.{name}", groups["trait"].rsplit("::", 1)[-1], line, 0.8)
            continue
        if kind in ("constant", "variable", "property", "type_alias"):
            if kind == "property" and any(s <= line <= e for s, e, _ in x.spans):
                continue  # a local
            x.symbol(kind, name, line, x.line(end) if kind != "property" else line, parent=parent, signature=" ".join(m.group().rstrip("{= \n").split()))
            continue
        if kind == "method" and not parent:
            kind = "function"
        if kind == "function" and parent and not parent.endswith(".tests"):
            kind = "method"
        if kind == "method" and parent and parent.rsplit(".", 1)[-1] == name:
            kind = "constructor"
        if kind in ("function", "method") and (re.search(TEST_MARKS.get(language, "(?!)"), head) or language == "go" and re.match(r"Test[A-Z_]", name) and "testing.T" in (groups.get("params") or "")):
            kind = "test_block"
        q = x.symbol(kind, name, line, x.line(end), parent=parent, signature=" ".join(m.group().rstrip("{ \n").split()))
        if kind in OWNERS:
            owners.append((at, end, q, _class_prefix(head, name)))
            _bases(x, language, q, groups, line)
            continue
        if kind == "test_block":
            tests.add(q)
        else:
            functions.setdefault(name, q)
        _annotated_route(x, head, inside[-1][1] if inside else "", q, line)
        for i, p in enumerate(split_parameters(groups.get("params") or "")):
            named = re.search(r"([A-Za-z_$]\w*)\s*(?:[:?=].*)?$", p) if language in ("java", "csharp") else re.search(r"([A-Za-z_$]\w*)", p)
            typed = bool(re.search(r":|\s", p))
            x.parameter(q, i, named.group(1) if named else p, p, 0.76 if typed else 0.58)
        for c in CALL.finditer(x.text, m.end(), end):
            if c.group("name") not in KEYWORDS:
                x.edge("CALLS", q, c.group("name"), x.line(c.start()), CALL_CONFIDENCE.get(language, 0.55))
                calls.append((q, c.group("name"), x.line(c.start())))
    # what a test calls in its own file is what it tests
    for q, name, line in calls:
        if q in tests and name in functions:
            x.edge("TESTS", q, functions[name], line, 0.75, dst_qname=functions[name])
    for m in re.finditer(IMPORTS[language], x.text):
        g = m.groupdict()
        module = g.get("module") or g.get("req")
        what = g.get("what") or ""
        if g.get("cjs"):
            pairs = re.findall(r"(\w+)(?:\s*:\s*(\w+))?", g["cjs"]) if g["cjs"].startswith("{") else [("default", g["cjs"])]
        else:
            # a name before the braces is the default one
            default = re.match(r"\s*(\w+)\s*(?:,|$)", what) if language in ("javascript", "typescript") else None
            pairs = [("default", default.group(1))] if default else []
            pairs += re.findall(r"(\w+|\*)(?:\s+as\s+(\w+))?", what[default.end() :] if default else what)
        for imported, local in pairs or [("", "")]:
            x.binding(local or imported or module.rsplit("/", 1)[-1], imported, module, x.line(m.start()))


# ---- framework facts

# Edge or symbol kind, pattern with the group name, confidence.
FACTS = [
    ("env_var", "READS_ENV_VAR", r"""(?:os\.environ(?:\.get)?\s*[\[(]\s*|os\.getenv\(\s*|process\.env(?:\.|\[)\s*|System\.getenv\(\s*|os\.Getenv\(\s*|env::var\(\s*|GetEnvironmentVariable\(\s*)["']?(?P<name>[A-Z_][A-Z0-9_]*)""", "env", 0.9),
    ("config_key", "READS_CONFIG_KEY", r"\b(?:settings|config)\.(?P<name>[A-Za-z_]\w*)\b(?!\s*\()", "config", 0.8),
    ("model", "QUERIES", r"\bprisma\.(?P<name>\w+)\.(?:find\w*|create\w*|update\w*|delete\w*|upsert|count|aggregate)\b", "prisma", 0.85),
    ("api_consumer", "FETCHES", r"""\b(?:fetch|axios(?:\.(?:get|post|put|patch|delete))?|requests\.\w+|httpx\.\w+)\(\s*[`"'](?P<name>[^`"']+)[`"']""", "http", 0.75),
    ("route", "HANDLES_ROUTE", r"""\b(?:app|router|server|fastify)\.(?P<verb>get|post|put|patch|delete)\(\s*[`"'](?P<name>/[^`"']*)[`"'][^)\n]*?(?P<handler>[A-Za-z_]\w*)\s*\)""", "express", 0.85),
    ("api_consumer", "FETCHES", r"""\b(?:fetch|axios(?:\.(?:get|post|put|patch|delete))?)\(\s*(?:`(?P<name>[^`]*\$\{[^`]*)`|(?P<variable>[A-Za-z_$][\w.$]*)\s*[,)])""", "http", 0.55),
    ("route", "ROUTES_TO", r"""\b(?:\w+)\.HandleFunc\(\s*"(?P<name>/[^"]*)"\s*,\s*(?:\w+\.)?(?P<handler>\w+)\s*\)(?:\.Methods\(\s*"(?P<verb>[A-Z]+)")?""", "route", 0.9),
    ("route", "ROUTES_TO", r"""\b\w+\.(?P<verb>GET|POST|PUT|PATCH|DELETE)\(\s*"(?P<name>/[^"]*)"\s*,\s*(?:\w+\.)?(?P<handler>\w+)\s*\)""", "route", 0.9),
    ("test_block", "TESTS", r"""\b(?:it|test|describe)\(\s*[`"'](?P<name>[^`"']+)[`"']""", "jest", 0.6),
    ("hook", "COMPONENT_USES_HOOK", r"\b(?P<name>use[A-Z]\w*)\s*\(", "react", 0.85),
]
NEXT_ROUTE = re.compile(r"(?:^|/)(?:app/(?P<app>.*?)/?route|pages/(?P<pages>api/.*?))\.(?:ts|js|tsx|jsx)$")


FASTIFY_ROUTE = re.compile(r"\.route\(\s*\{(?P<body>[^}]*)\}", re.S)
JEST_BODY = re.compile(r"""\b(?:it|test)\(\s*[`"'](?P<name>[^`"']+)[`"']\s*,\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>\s*\{""")


def short_label(text: str, most: int = 120) -> str:
    """A test's label as part of a name: a long one is cut and told apart by a hash of the whole."""
    return text if len(text) <= most else f"{text[:most]}~{zlib.crc32(text.encode()):08x}"


def _facts(x: Extract, language: str) -> None:
    for kind, edge, pattern, prefix, confidence in FACTS:
        if kind == "hook" and not x.path.endswith((".tsx", ".jsx")) or kind == "test_block" and language not in ("javascript", "typescript"):
            continue
        for m in re.finditer(pattern, x.text):
            name, line = m.group("name") or m.groupdict().get("variable"), x.line(m.start())
            if kind == "api_consumer" and confidence == 0.75 and "${" in name:
                continue  # its address is made while it runs
            if confidence == 0.55 and "${" in name:
                name = re.sub(r"\$\{[^}]*\}", ":param", name)
            verb = (m.groupdict().get("verb") or "").upper()
            qname = f"{prefix}::{x.path}::{short_label(name)}" if kind == "test_block" else f"{prefix}::{verb + ' ' if verb else ''}{name}"
            source = x.enclosing(line)
            if kind == "route":
                x.symbol(kind, f"{verb} {name}", line, line, qname=qname, http_method=verb, path=name)
                x.edge(edge, qname, m.groupdict().get("handler") or source.rsplit(".", 1)[-1], line, confidence)
                if prefix == "express":
                    # the arguments between the path and the handler are passed through first
                    between = x.text[m.end("name") + 1 : m.start("handler")]
                    for name in re.findall(r"(?<![\w.])([A-Za-z_$]\w*)\s*(?=,)", between):
                        x.edge("USES_MIDDLEWARE", qname, name, line, 0.8)
            elif kind == "hook":
                x.edge(edge, source, name, line, confidence)
            else:
                x.symbol(kind, name, line, line, qname=qname)
                x.edge(edge, source if kind != "test_block" else qname, name if kind != "test_block" else x.module, line, confidence)
                if kind == "model":
                    x.edge("MODEL_USED_BY", qname, source, line, 0.7)
                if kind == "api_consumer" and name.startswith("http"):
                    x.edge("CALLS_EXTERNAL", source, name, line, 0.7)
    if language in ("javascript", "typescript"):
        for m in FASTIFY_ROUTE.finditer(x.text):
            told = {k: re.search(rf"""\b{k}\s*:\s*['"`]?([^'"`,}}\s]+)""", m.group("body")) for k in ("method", "url", "handler")}
            if told["url"]:
                verb, path = told["method"].group(1).upper() if told["method"] else "ANY", told["url"].group(1)
                r = x.symbol("route", f"{verb} {path}", x.line(m.start()), x.line(m.end()), qname=f"fastify::{verb} {path}", http_method=verb, path=path)
                if told["handler"]:
                    x.edge("HANDLES_ROUTE", r, told["handler"].group(1).rsplit(".", 1)[-1], x.line(m.start()), 0.85)
        imported = {r["name"] for r in x.rows if r["record"] == "import"}
        for m in JEST_BODY.finditer(x.text):
            t = f"jest::{x.path}::{short_label(m.group('name'))}"
            end = matching_brace(x.text, m.end() - 1)
            for c in CALL.finditer(x.text, m.end(), end):
                if c.group("name") in imported:
                    x.edge("TESTS_SYMBOL", t, c.group("name"), x.line(c.start()), 0.55)
    if (m := NEXT_ROUTE.search(x.path)) and language in ("javascript", "typescript"):
        path = "/" + re.sub(r"\[\.*(\w+)\]", r":\1", m.group("app") or m.group("pages") or "")
        for verb in re.findall(r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b", x.text) or ["ANY"]:
            x.symbol("route", f"{verb} {path}", 1, 1, qname=f"nextjs::{verb} {path}", http_method=verb, path=path)


DETECTORS: list[Callable[[Extract, str], None]] = [_facts]
"""What looks for framework facts in an extract; further ones are appended."""
PROVIDERS: dict[str, Callable[[Extract, str], None]] = {"python": lambda x, language: _python(x), **dict.fromkeys(DEFINITIONS, _braces)}
"""The parser of each language; one that is put here replaces the own one."""


def parse_text(path: str, language: str, text: str) -> list[dict]:
    """All rows of one file; a file that gives no symbol, or does not parse, gets a ``file_summary``."""
    x = Extract(path, text)
    try:
        if language in PROVIDERS:
            PROVIDERS[language](x, language)
        for detect in DETECTORS:
            detect(x, language)
    except (SyntaxError, ValueError, RecursionError):
        x.rows.clear()
    if not any(r["record"] == "symbol" for r in x.rows):
        x.symbol("file_summary", path.rsplit("/", 1)[-1], 1, text.count("\n") + 1, qname=f"file::{path}")
    return [{"path": path, **r} for r in x.rows]


def parse_files(files: DataFrame) -> DataFrame:
    """Symbols, edges, imports and parameters of ``files`` (``path, language, content``) as rows of one table.

    ``record`` tells them apart. Null contents and languages give nothing. Only the three columns are read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, l, t in zip(batch["path"], batch["language"], batch["content"]) for r in parse_text(p, l, t.lstrip("﻿"))]
            # missing values stay None: a column of numbers that stand for missing text can't be sent back
            frame = pd.DataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], columns=COLUMNS, dtype=object)
            yield frame.astype({"start_line": "Int32", "end_line": "Int32", "confidence": "float64"})

    chosen = files.select("path", "language", "content").where("path is not null and language is not null and content is not null")
    return chosen.mapInPandas(run, SCHEMA)


def symbols_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("record = 'symbol'").select("path", "kind", "name", "qname", "parent", "start_line", "end_line", "signature", "docstring", "metadata_json")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("record = 'edge'").select("path", F.col("kind").alias("edge_type"), F.col("qname").alias("src"), "dst_name", F.col("start_line").alias("line"), "confidence", "metadata_json")


def imports_of(parsed: DataFrame) -> DataFrame:
    module = F.get_json_object("metadata_json", "$.source_module")
    return parsed.where("record = 'import'").select("path", F.col("name").alias("local_name"), F.col("dst_name").alias("imported_name"), module.alias("source_module"), F.col("start_line").alias("line"))


def parameters_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("record = 'parameter'").select(F.col("qname").alias("owner_qname"), F.col("start_line").alias("position"), "name", F.col("kind").alias("declared_type"), "confidence")
