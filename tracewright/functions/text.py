"""Column functions over SQL text, file names and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexing import sql_without_comments

WRITES = ("WRITE", "WRITE_INDIRECT", "INSERT", "UPDATE", "DELETE", "MERGE", "SELECT_INTO")

#: One part of a written name, and a name of up to four parts of which inner ones may be empty.
_PART = r"(?:\[[^\]]+\]|\w+)"
_NAME = rf"({_PART}(?:\.{_PART}?){{0,3}})(?![\w.])"
#: What introduces a table; but for INSERT, whose columns may follow, a name before ``(`` is a function.
_TABLE_PATTERNS = (
    rf"\bFROM\s+{_NAME}(?!\s*\()", rf"\bJOIN\s+{_NAME}(?!\s*\()", rf"\bINSERT\s+INTO\s+{_NAME}", rf"\bMERGE\s+(?:INTO\s+)?{_NAME}(?!\s*\()",
    rf"\bUSING\s+{_NAME}(?!\s*\()", rf"\bUPDATE\s+(?!SET\b){_NAME}(?!\s*\()", rf"\bDELETE\s+FROM\s+{_NAME}(?!\s*\()",
)
#: The same for the quick look at a module: any run of name characters after one of four words.
_QUICK_PATTERNS = tuple(rf"{w}\s+([\[\w\].]+)" for w in ("FROM", "JOIN", "INTO", "UPDATE"))
_QUICK_WORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "EXEC", "EXECUTE")


def collapse(text: Column) -> Column:
    """White space runs become one space, ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_sql(text: Column) -> Column:
    """Collapsed text without what follows ``--``; the order matters, so it cuts to the end."""
    return F.trim(F.regexp_replace(collapse(text), r"--.*$", ""))


def sql_type(text: Column) -> Column:
    """The statement's type by its leading keyword."""
    word = F.upper(F.regexp_extract(text, r"^\s*(\w+)", 1))
    kind = F.lit("UNKNOWN")
    for words, name in (
        (("WITH",), "SELECT"), (("EXEC", "EXECUTE"), "EXEC"), (("TRUNCATE",), "TRUNCATE"), (("MERGE",), "MERGE"), (("DROP",), "DROP"),
        (("ALTER",), "ALTER"), (("CREATE",), "CREATE"), (("DELETE",), "DELETE"), (("UPDATE",), "UPDATE"), (("INSERT",), "INSERT"), (("SELECT",), "SELECT"),
    ):
        kind = F.when(word.isin(*words), name).otherwise(kind)
    return kind


def kept_statement(text: Column) -> Column:
    """Whether a text is a statement to keep: of a known type, or a WITH or MERGE."""
    return (sql_type(text) != "UNKNOWN") | F.upper(F.trim(text)).rlike("^(WITH|MERGE)")


def valid_procedure_name(name: Column, prefixes: tuple[str, ...] = ()) -> Column:
    ok = F.length(F.trim(name)) >= 3
    return ok & name.rlike("(?i)" + "|".join(prefixes)) if prefixes else ok


def is_write(access: Column) -> Column:
    return F.upper(F.coalesce(access, F.lit(""))).isin(*WRITES)


def _uncommented(text: Column) -> Column:
    return F.when(text.rlike(r"--|/\*"), sql_without_comments(text)).otherwise(text)


def tables(text: Column) -> Column:
    """Distinct tables that a statement names, as written but for brackets; comments are not read.

    Parts that are not stated stay empty (``PUR..Users``). Names of one character are none.
    """
    clean = _uncommented(text)
    found = [F.regexp_extract_all(clean, F.lit(f"(?iU){p}"), F.lit(1)) for p in _TABLE_PATTERNS]
    plain = F.transform(F.flatten(F.array(*found)), lambda t: F.translate(t, "[]", ""))
    return F.array_distinct(F.filter(plain, lambda t: F.length(F.element_at(F.split(t, r"\."), -1)) > 1))


def quick_tables(text: Column) -> Column:
    """Tables of a module's body at a quick look: what follows four words, but for temporary ones, variables and keywords."""
    clean = F.regexp_replace(F.regexp_replace(text, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")
    found = F.flatten(F.array(*[F.regexp_extract_all(clean, F.lit(f"(?iU){p}"), F.lit(1)) for p in _QUICK_PATTERNS]))
    plain = F.transform(found, lambda t: F.translate(t, "[]", ""))
    return F.array_distinct(F.filter(plain, lambda t: (F.length(t) > 1) & ~F.upper(t).isin(*_QUICK_WORDS)))


def flags(text: Column) -> Column:
    """STRUCT of dynamic_sql, temp_table, cursor, transaction. Only a command in a variable is dynamic."""
    return F.struct(
        text.rlike(r"(?i)EXEC\s*\(\s*@|sp_executesql").alias("dynamic_sql"),
        text.rlike(r"(?U)#\w+").alias("temp_table"),
        text.rlike(r"(?iU)DECLARE\s+\w+\s+CURSOR").alias("cursor"),
        text.rlike(r"(?iU)BEGIN\s+TRAN").alias("transaction"),
    )


def complexity(length: Column, n_tables: Column, n_lines: Column, dynamic: Column, temp: Column, cursor: Column, transaction: Column) -> Column:
    """Score of a module; 6 and more is complex, 3 and more medium."""
    steps = lambda x, cuts: F.when(x > cuts[0][0], cuts[0][1]).otherwise(steps(x, cuts[1:])) if cuts else F.lit(0)
    weight = lambda flag, w: F.when(flag, w).otherwise(0)
    return (
        weight(dynamic, 3) + weight(temp, 2) + weight(cursor, 2) + weight(transaction, 1)
        + steps(length, ((10000, 3), (5000, 2), (2000, 1))) + steps(n_tables, ((10, 2), (5, 1))) + steps(n_lines, ((500, 2), (200, 1)))
    )


def band(score: Column) -> Column:
    return F.when(score >= 6, "complex").when(score >= 3, "medium").otherwise("simple")


def column_match(column: str, *texts: Column) -> Column:
    """Whole word, either case, in any of the texts or arrays of texts."""
    escaped = "".join(c if c.isalnum() or c == "_" else "\\" + c for c in column)
    return F.concat_ws("\n", *texts).rlike(rf"(?iU)(?<!\w){escaped}(?!\w)")


def program_match(file_name: Column, program: str, suffixes: tuple[str, ...] = (".aspx.cs", ".ascx.cs", ".cshtml.cs", ".aspx", ".ascx", ".cshtml", ".vue", ".cs")) -> Column:
    """Equal base name, or the program as part of the file name."""
    low = F.lower(file_name)
    base = low
    for s in sorted(suffixes, key=len):
        base = F.when(low.endswith(s), F.substring(low, F.lit(1), F.length(low) - len(s))).otherwise(base)
    return (base == program.lower()) | low.contains(program.lower())


def file_category(path: Column) -> Column:
    """Category of a project file by its folder and extension."""
    low = F.lower(F.translate(path, "\\", "/"))
    return (
        F.when(low.rlike(r"/controllers?/.*\.cs$|controller\.cs$"), "controller")
        .when(low.rlike(r"/(services?|bll)/.*\.cs$|service\.cs$"), "service")
        .when(low.rlike(r"/(repositor(y|ies)|dal|dao)/.*\.cs$|repository\.cs$"), "repository")
        .when(low.rlike(r"/(models?|entities|viewmodels?|dtos?)/.*\.cs$"), "model")
        .when(low.rlike(r"\.(cshtml|razor)$"), "razor_view")
        .when(low.rlike(r"\.(aspx|ascx|master)(\.cs)?$"), "webforms")
        .when(low.rlike(r"\.vue$"), "vue")
        .when(low.rlike(r"\.(js|ts)$"), "script")
        .when(low.rlike(r"\.cs$"), "csharp")
        .otherwise("other")
    )


def receiver_signal(declared_type: Column) -> Column:
    """Whether a declared type can hold a database connection."""
    return declared_type.rlike(r"(?i)(sql|db|data|connection|context|database|dapper|repository)")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", "")


def attributes(tag: Column) -> Column:
    """MAP of a tag's quoted attributes, names in lower case; a value keeps the other kind of quote."""
    pattern = r"""([\w:-]+)\s*=\s*("[^"]*"|'[^']*')"""
    names = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(2)), lambda v: F.substring(v, F.lit(2), F.length(v) - 2))
    first = F.filter(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_position(names, F.get(names, i - 1)) == i)
    made = F.map_from_arrays(F.transform(first, lambda i: F.get(names, i - 1)), F.transform(first, lambda i: F.get(values, i - 1)))
    return F.when(F.size(names) > 0, made).otherwise(F.create_map().cast("map<string,string>"))


def component_key(name: Column) -> Column:
    """Component names compare without hyphens, underscores and case."""
    return F.lower(F.translate(name, "-_", ""))


def url_segments(url: Column) -> Column:
    """Path segments of a URL without scheme, host, query and fragment."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-zA-Z][\w+.-]*://[^/]*", "")
    return F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "~"))


def leading_action(url: Column) -> Column:
    """STRUCT<controller, action> of the first two segments, null with fewer."""
    s = url_segments(url)
    return F.when(F.size(s) >= 2, F.struct(F.get(s, 0).alias("controller"), F.get(s, 1).alias("action")))


def exact_action(url: Column) -> Column:
    """As ``leading_action``, but of exactly two segments, or three of which the last is a route value."""
    s = url_segments(url)
    value = F.get(s, 2).rlike(r"^(\d+|\{.*\}|@.*|[0-9a-fA-F-]{36})$")
    return F.when((F.size(s) == 2) | ((F.size(s) == 3) & value), F.struct(F.get(s, 0).alias("controller"), F.get(s, 1).alias("action")))


def procedure_hint(text: Column) -> Column:
    """Whether a lone identifier looks like a procedure's name."""
    return F.trim(text).rlike(r"(?i)^(\[?\w+\]?\.){0,3}\[?(usp|sp|proc)_?\w*\]?$")


def leading_keyword(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"(?i)^\s*(SELECT|INSERT|UPDATE|DELETE|MERGE|WITH|EXEC|EXECUTE|DECLARE|TRUNCATE)\b", 1))


def line_counts(text: Column) -> Column:
    """STRUCT<code, comment, blank> lines of a C# text.

    A line with ``/*`` opens a block even if the block closes on the same line; a block ends with the line that has
    ``*/``. Lines of a block and lines that begin with ``//`` are comments.
    """
    zero = F.struct(F.lit(0).alias("code"), F.lit(0).alias("comment"), F.lit(0).alias("blank"), F.lit(False).alias("block"))

    def step(a: Column, raw: Column) -> Column:
        line = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
        blank = line == ""
        opens, closes = line.contains("/*"), line.contains("*/")
        comment = ~blank & (a["block"] | opens | line.startswith("//"))
        return F.struct(
            (a["code"] + F.when(~blank & ~comment, 1).otherwise(0)).alias("code"),
            (a["comment"] + F.when(comment, 1).otherwise(0)).alias("comment"),
            (a["blank"] + F.when(blank, 1).otherwise(0)).alias("blank"),
            F.when(a["block"], ~closes).otherwise(opens & ~blank).alias("block"),
        )

    return F.aggregate(F.split(text, "\n"), zero, step, lambda a: F.struct(a["code"].alias("code"), a["comment"].alias("comment"), a["blank"].alias("blank")))


def snippet(text: Column, first: int = 40, most: int = 600) -> Column:
    """The first lines of a text without its blank ones."""
    lines = F.slice(F.split(text, "\n"), 1, min(first, most))
    return F.filter(lines, lambda x: F.trim(x) != "")


def id_segments(*segments: Column) -> Column:
    """Segments of a path's id as one text, nulls as '', so that those of a chain or an invocation are put together once."""
    return F.concat_ws("\x1f", *[F.coalesce(s.cast("string"), F.lit("")) for s in segments])


def path_id_of(*joined: Column) -> Column:
    """``P-`` and 12 hex digits of the SHA-256 over eleven segments, given as texts of ``id_segments`` in their order.

    These are database, file, start, end, entry, schema, procedure, snapshot, modules, operation and conditions, joined by
    the unit separator; modules are joined by ``|``, conditions by the record separator; the names are comparison keys.
    """
    return F.concat(F.lit("P-"), F.substring(F.sha2(id_segments(*joined), 256), 1, 12))
