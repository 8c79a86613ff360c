"""View parsers: WebForms, Razor and Vue, and the C# outline. Each is text to rows, run over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .lexing import strip_csharp_comments, strip_sql_comments

FACT = "path string, kind string, name string, detail string, strength string, line int"
Fact = tuple[str, str, str, str, int]  # kind, name, detail, strength, offset

_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
SQL_WORDS = r"SELECT|INSERT|UPDATE|DELETE|MERGE|WITH|EXEC|EXECUTE|TRUNCATE"


def attributes(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3])
    return found


def webforms(text: str) -> Iterator[Fact]:
    """Directives, controls by id, events and code-behind of an ASPX page."""
    for m in re.finditer(r"<%@\s*(\w+)(.*?)%>", text, re.S):
        a = attributes(m[2])
        yield "directive", m[1], ";".join(f"{k}={v}" for k, v in a.items()), "determined", m.start()
        for key in ("codebehind", "codefile"):
            if key in a:
                yield "code_behind", a[key], a.get("inherits", ""), "determined", m.start()
    for m in re.finditer(r"<(asp|uc\d*|\w+):(\w+)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", text):
        a = attributes(m[3])
        if "id" in a:
            yield "control", a["id"], f"{m[1]}:{m[2]}", "determined", m.start()
        for k, v in a.items():
            if re.fullmatch(r"on\w+", k) and re.fullmatch(r"\w+", v):
                yield "event", v, f"{a.get('id', '')}.{k}", "determined", m.start()
        if m[2].lower() in ("boundfield", "templatefield", "label"):
            yield "ui_field", a.get("datafield") or a.get("id", ""), a.get("headertext") or a.get("text", ""), "determined", m.start()
    for m in re.finditer(r"<%[=#:]?(?!@)(.*?)%>", text, re.S):
        if m[1].strip():
            yield "inline_code", "", m[1].strip(), "determined", m.start()


def _anchor(url: str) -> tuple[str, str] | None:
    parts = [p for p in re.sub(r"^[a-zA-Z][\w+.-]*://[^/]*|[?#].*$", "", url).split("/") if p and p != "~"]
    return (parts[0], parts[1]) if len(parts) >= 2 else None


def razor(text: str) -> Iterator[Fact]:
    """Directives, helpers, tag helpers, partial views, components and anchors; anchors of text are candidates only."""
    for m in re.finditer(r"^\s*@(model|page|inject|using|layout|inherits)\s+(.+?)\s*$", text, re.M):
        yield "directive", m[1], m[2], "determined", m.start()
    for m in re.finditer(r"""@?(?:Html\.(?:BeginForm|ActionLink|RouteLink)|Url\.Action|Html\.Action|Html\.RenderAction)\(\s*((?:"[^"]*"\s*,?\s*){1,3})""", text):
        args = re.findall(r'"([^"]*)"', m[1])
        args = args[1:] if "ActionLink" in m[0] else args
        if args:
            yield "anchor", args[0], args[1] if len(args) > 1 else "", "determined", m.start()
    for m in re.finditer(r"<\w+\b[^>]*\basp-action\s*=[^>]*>", text):
        a = attributes(m[0])
        yield "anchor", a.get("asp-action", ""), a.get("asp-controller", ""), "determined", m.start()
    for m in re.finditer(r"<form\b[^>]*>|\$\.(?:ajax|get|post|getJSON)\(\s*[^)]*|fetch\(\s*[^)]*|<a\b[^>]*>", text):
        for url in re.findall(r"""["']((?:~?/|https?://)[^"'\s]+)["']""", m[0]):
            if found := _anchor(url):
                yield "anchor", found[1], found[0], "candidate", m.start()
    for m in re.finditer(r"""Html\.(?:Partial|RenderPartial|PartialAsync|RenderPartialAsync)\(\s*"([^"]+)"|<partial\b[^>]*\bname\s*=\s*"([^"]+)\"""", text):
        yield "partial", m[1] or m[2], "", "determined", m.start()
    for m in re.finditer(r"""Component\.InvokeAsync\(\s*"(\w+)"|<vc:([\w-]+)""", text):
        yield "component", m[1] or m[2], "", "determined", m.start()
    for m in re.finditer(r"""Html\.(\w+For)\(\s*\w+\s*=>\s*\w+\.([\w.]+)|\basp-for\s*=\s*"(?:Model\.)?([\w.]+)\"""", text):
        yield "ui_field", m[2] or m[3], m[1] or "asp-for", "determined", m.start()


def vue(text: str) -> Iterator[Fact]:
    """Sections, components and API calls (axios, fetch, $http) of a single file component."""
    for m in re.finditer(r"<(template|script|style)\b([^>]*)>", text):
        yield "section", m[1], m[2].strip(), "determined", m.start()
    for m in re.finditer(r"""import\s+(\w+)\s+from\s+["']([^"']+\.vue)["']""", text):
        yield "component", m[1], m[2], "determined", m.start()
    for m in re.finditer(r"""(?:axios|\$http)\.(get|post|put|delete|patch)\(\s*[`"']([^`"']+)[`"']""", text):
        yield "api_call", m[2], m[1].upper(), "determined", m.start()
    for m in re.finditer(r"""fetch\(\s*[`"']([^`"']+)[`"']\s*(?:,\s*\{[^}]*?method\s*:\s*["'](\w+)["'])?""", text):
        yield "api_call", m[1], (m[2] or "GET").upper(), "determined", m.start()


_CLASS = re.compile(r"\b(?:public|internal|private|protected|static|abstract|sealed|partial|\s)*\b(class|interface|struct|record)\s+(\w+)(?:<[^>{]*>)?\s*(?::\s*([^{;]+))?")
_METHOD = re.compile(r"\b((?:(?:public|private|protected|internal|static|virtual|override|async|sealed|new|abstract)[ \t]+)+)([\w<>\[\],.?]+)[ \t]+(\w+)[ \t]*\(([^()]*)\)")
_PROPERTY = re.compile(r"\b(?:public|internal|protected)[ \t]+(?:virtual[ \t]+|static[ \t]+)*([\w<>\[\]?.]+)[ \t]+(\w+)\s*\{\s*get")
_STRING = r'(?:\$?@?"((?:[^"\\]|\\.|"")*)")'


#: Methods that take a procedure's name first: of data helpers, of Dapper, and of Entity Framework, whose text begins with EXEC.
WRAPPERS = ("ExecuteStoredProcedure", "ExecuteProcedure", "RunProcedure", "ExecSP", "ExecuteSP", "GetDataTableBySP", "GetDataSetBySP")
DAPPER = ("Query", "QueryAsync", "QueryFirst", "QueryFirstAsync", "QueryFirstOrDefault", "QueryFirstOrDefaultAsync", "QuerySingleOrDefault", "QueryMultiple", "Execute", "ExecuteAsync", "ExecuteScalar")
ENTITY = ("FromSqlRaw", "FromSqlInterpolated", "FromSql", "ExecuteSqlRaw", "ExecuteSqlRawAsync", "ExecuteSqlInterpolated", "ExecuteSqlCommand", "SqlQuery")
_NAME = r"[A-Za-z_\[][\w\[\].]{2,}"


def _names_in(clean: str) -> dict[str, str]:
    """Variables and constants that one text is assigned to, once or always the same."""
    found: dict[str, set[str]] = {}
    for m in re.finditer(rf"\b(\w+)\s*=\s*{_STRING}\s*;", clean):
        found.setdefault(m[1], set()).add(m[2])
    return {v: texts.pop() for v, texts in found.items() if len(texts) == 1}


def _arguments(clean: str, at: int) -> str:
    """What stands between the parenthesis at ``at`` and the one that closes it."""
    depth = 0
    for m in re.finditer(rf"{_STRING}|[()]", clean[at:]):
        depth += (m[0] == "(") - (m[0] == ")")
        if not depth:
            return clean[at + 1 : at + m.start()]
    return clean[at + 1 :]


def procedure_calls(clean: str, wrappers: tuple[str, ...] = WRAPPERS) -> Iterator[Fact]:
    """Procedures that helper methods, Dapper, Entity Framework and command objects name, by a text or a variable's text."""
    known, seen = _names_in(clean), set()

    def named(argument: str) -> str | None:
        first = re.match(rf"\s*(?:{_STRING}|(\w+)\s*(?:,|$))", argument)
        return (first[1] if first[1] is not None else known.get(first[2])) if first else None

    def fact(name: str | None, how: str, at: int) -> Iterator[Fact]:
        if name and re.fullmatch(_NAME, name) and (name, at) not in seen:
            seen.add((name, at))
            yield "procedure_call", name, how, "determined", at

    for m in re.finditer(rf"\b\w+\s*\.\s*({'|'.join(map(re.escape, wrappers))})\s*\(", clean, re.I):
        yield from fact(named(_arguments(clean, m.end() - 1)), "wrapper", m.start())
    for m in re.finditer(rf"\.\s*({'|'.join(DAPPER)})\s*(?:<[^<>()]*(?:<[^<>()]*>)?[^<>()]*>)?\s*\(", clean):
        arguments = _arguments(clean, m.end() - 1)
        text = named(arguments)
        execs = re.match(rf"(?i)\s*EXEC(?:UTE)?\s+({_NAME})", text or "")
        if "CommandType.StoredProcedure" in arguments:
            yield from fact(text, "dapper", m.start())
        elif execs:
            yield from fact(execs[1], "dapper", m.start())
    for m in re.finditer(rf"\.\s*({'|'.join(ENTITY)})\s*(?:<[^<>()]*>)?\s*\(", clean):
        execs = re.match(rf"(?i)\s*EXEC(?:UTE)?\s+({_NAME})", named(_arguments(clean, m.end() - 1)) or "")
        yield from fact(execs and execs[1], "entity_framework", m.start())
    for m in re.finditer(r"\bnew\s+\w*Command\s*\(|\.\s*CommandText\s*=\s*", clean):
        argument = _arguments(clean, m.end() - 1) if m[0].endswith("(") else clean[m.end() :].split(";", 1)[0]
        if not re.match(rf"\s*{_STRING}", argument) and "CommandType.StoredProcedure" in clean[m.end() : m.end() + 600]:
            yield from fact(named(argument), "variable", m.start())


#: How a key is looked up: the pattern of the expression, the name space of its key.
_LOOKUPS = (
    (r'ConnectionStrings\s*\[\s*"([^"]+)"\s*\]', "connection_strings"),
    (r'\bGetConnectionString\s*\(\s*"([^"]+)"\s*\)', "connection_strings"),
    (r'\bAppSettings\s*\[\s*"([^"]+)"\s*\]', "app_settings"),
    (r'\b_?[Cc]onfig(?:uration)?\s*\[\s*"([^"]+)"\s*\]', "root"),
)


def connections(clean: str) -> Iterator[Fact]:
    """Variables that hold a connection, with the name space and key that it is looked up by, or why that is not known.

    An object made over a lookup, a text or another variable, a field that is assigned one, and a receiver whose type is
    a registered context.
    """
    def looked_up(expression: str) -> str:
        for pattern, space in _LOOKUPS:
            if m := re.search(pattern, expression):
                return f"{space}:{m[1].removeprefix('ConnectionStrings:')}" if space != "root" or m[1].startswith("ConnectionStrings:") else f"{space}:{m[1]}"
        return ""

    held = {m[1]: looked_up(m[2]) for m in re.finditer(r"\b(\w+)\s*=\s*([^;{}=]+);", clean) if looked_up(m[2])}
    for m in re.finditer(r"\b(\w+)\s*=\s*new\s+(\w*(?:Connection|Func|Helper|Manager))\s*\(", clean):
        argument = _arguments(clean, m.end() - 1).strip()
        detail = looked_up(argument) or held.get(argument.removeprefix("this."), "")
        if not detail and (text := re.fullmatch(_STRING, argument)):
            detail = f"text:{text[1]}" if "=" in text[1] else f"connection_strings:{text[1]}"
        yield "connection", m[1], detail or "unresolved:dynamic_connection_source", "determined" if detail else "candidate", m.start()
    for m in re.finditer(r"\b(?:private|protected|public|internal)\s+(?:readonly\s+)?(\w*Context)\s+(\w+)\s*[;=]", clean):
        yield "connection", m[2], f"context:{m[1]}", "determined", m.start()
    for v, detail in held.items():
        yield "connection_key", v, detail, "determined", clean.index(v)


def csharp(text: str) -> Iterator[Fact]:
    """Namespaces, usings, classes, methods, properties, calls, SQL texts, procedure calls and endpoints of a C# file."""
    clean = strip_csharp_comments(text)
    for m in re.finditer(r"^\s*namespace\s+([\w.]+)|^\s*using\s+(?:static\s+)?([\w.]+)\s*;", clean, re.M):
        yield ("namespace", m[1], "", "determined", m.start()) if m[1] else ("using", m[2], "", "determined", m.start())
    for m in _CLASS.finditer(clean):
        yield "class", m[2], re.sub(r"\s+", " ", (m[3] or "").strip()), "determined", m.start(2)
    for m in _METHOD.finditer(clean):
        if m[2] not in ("class", "return", "new", "else"):
            yield "method", m[3], re.sub(r"\s+", " ", m[4].strip()), "determined", m.start(3)
    for m in _PROPERTY.finditer(clean):
        yield "property", m[2], m[1], "determined", m.start(2)
    for m in re.finditer(r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"]*)\")?", clean):
        yield "endpoint", m[2] or "", m[1].upper(), "determined", m.start()
    for m in re.finditer(r"\bCommandType\.StoredProcedure\b", clean):
        before = list(re.finditer(_STRING, clean[max(0, m.start() - 400) : m.start()]))
        if before and re.fullmatch(r"[\w\[\].]{3,}", before[-1][1]):
            yield "procedure_call", before[-1][1], "command_type", "determined", m.start()
    for m in re.finditer(_STRING, clean):
        body = (m[1] or "").strip()
        if call := re.match(r"(?i)EXEC(?:UTE)?\s+([\w\[\].]+)", body):
            yield "procedure_call", call[1], "exec_text", "determined", m.start()
        elif re.match(rf"(?i)({SQL_WORDS})\b\s+\S", strip_sql_comments(body)):
            yield "sql_text", re.match(r"\w+", body)[0].upper() if re.match(r"\w+", body) else "", body, "determined", m.start()
    yield from procedure_calls(clean)
    yield from connections(clean)
    for m in re.finditer(r"\b(\w+)\s*\.\s*(\w+)\s*\(", clean):
        yield "call", m[2], m[1], "candidate", m.start()


PARSERS: dict[str, Callable[[str], Iterator[Fact]]] = {"webforms": webforms, "razor": razor, "vue": vue, "csharp": csharp}


def facts(files: DataFrame, parser: str) -> DataFrame:
    """``files(path, content)`` -> what the parser finds, with the line it is on."""
    parse = PARSERS[parser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, k, n, d, s, (c or "").count("\n", 0, at) + 1) for p, c in zip(batch["path"], batch["content"]) for k, n, d, s, at in parse(c or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "detail", "strength", "line"]).astype({"line": "int32"})

    return files.select("path", "content").mapInPandas(run, FACT)


def project_type(paths: set[str]) -> str:
    """Framework of a project by its files: Vue, WebForms, MVC or Razor, plain C#, else unknown."""
    low = {p.lower() for p in paths}
    for name, test in (("vue", r"\.vue$"), ("webforms", r"\.(aspx|ascx)$"), ("mvc", r"\.cshtml$|controller\.cs$"), ("csharp", r"\.cs$")):
        if any(re.search(test, p) for p in low):
            return name
    return "unknown"
