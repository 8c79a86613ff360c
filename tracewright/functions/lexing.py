"""Comment stripping for T-SQL and C#, and a T-SQL tokenizer. Plain Python, used inside ``mapInPandas`` and Pandas UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_SQL_SKIP = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|\[(?:[^\]]|\]\])*\]|--[^\n]*|/\*")
_CS_SKIP = re.compile(
    r'\$*"""[\s\S]*?"""|(?:\$@|@\$|@)"(?:[^"]|"")*"|\$?"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\'|//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)'
)


def _comment_end(text: str, start: int) -> int:
    """End of a T-SQL block comment, which may hold others."""
    depth, at = 0, start
    for m in re.finditer(r"/\*|\*/", text[start:]):
        depth += 1 if m[0] == "/*" else -1
        at = start + m.end()
        if not depth:
            return at
    return len(text)


def strip_sql_comments(text: str) -> str:
    """Each comment becomes one space; quoted text and bracketed names are left alone."""
    out, at = [], 0
    while m := _SQL_SKIP.search(text, at):
        out.append(text[at : m.start()])
        at = m.end()
        if m[0] == "/*":
            at = _comment_end(text, m.start())
            out.append(" ")
        else:
            out.append(" " if m[0].startswith("--") else m[0])
    return "".join([*out, text[at:]])


def strip_csharp_comments(text: str) -> str:
    """Comments become blanks of the same length; strings of every form are left alone, line ends stay."""

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0]) if m[0].startswith(("//", "/*")) else m[0]

    return _CS_SKIP.sub(blank, text)


@pandas_udf(StringType())
def sql_without_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_sql_comments(t))


@pandas_udf(StringType())
def csharp_without_comments(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else strip_csharp_comments(t))


@pandas_udf(StringType())
def decoded(contents: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without a mark, else cp950, else latin-1."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        for name in ("utf-8-sig", "cp950"):
            try:
                return bytes(raw).decode(name)
            except UnicodeDecodeError:
                pass
        return bytes(raw).decode("latin-1")

    return contents.map(one)


def utf16_slice(text: str, start: int, length: int) -> str:
    """A slice by UTF-16 code units, as compilers count them."""
    return text.encode("utf-16-le")[2 * start : 2 * (start + length)].decode("utf-16-le", "replace")
