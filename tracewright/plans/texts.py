"""Text functions over the pages and documents, and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import resolve

from .registry import query


@query("""WITH u AS (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][\\w+.-]*://[^/]*', ''), '/'), lambda x: x <> '' AND x <> '~') AS s FROM pages)
SELECT page_id, CASE WHEN len(s) >= 2 THEN s[1] END AS controller, CASE WHEN len(s) >= 2 THEN s[2] END AS action, len(s) = 2 OR (len(s) = 3 AND regexp_matches(s[3], '^(\\d+|\\{.*\\}|@.*|[0-9a-fA-F-]{36})$')) AS exact FROM u""")
def url_actions(t):
    """controller and action of a URL."""
    u = t("pages").select("page_id", X.leading_action(F.col("url")).alias("a"), X.exact_action(F.col("url")).isNotNull().alias("exact"))
    return u.select("page_id", "a.controller", "a.action", "exact")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n_chars, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest FROM pages")
def stripped_pages(t):
    """pages without tags."""
    s = X.strip_tags(F.col("html"))
    return t("pages").select("page_id", F.length(s).cast("long").alias("n_chars"), F.md5(s.cast("binary")).alias("digest"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages""")
def page_anchors(t):
    """Link targets of views, a row each."""
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("""WITH d AS (SELECT doc_id, length(text) AS n, len(string_split(text, chr(10))) AS l FROM documents), s AS (SELECT doc_id, CASE WHEN n > 10000 THEN 3 WHEN n > 5000 THEN 2 WHEN n > 2000 THEN 1 ELSE 0 END + CASE WHEN l > 500 THEN 2 WHEN l > 200 THEN 1 ELSE 0 END AS score FROM d)
SELECT doc_id, score, CASE WHEN score >= 6 THEN 'complex' WHEN score >= 3 THEN 'medium' ELSE 'simple' END AS band FROM s""")
def text_complexity(t):
    """Complexity score and band."""
    no = F.lit(False)
    s = X.complexity(F.length("text"), F.lit(0), F.size(F.split("text", "\n")), no, no, no, no)
    return t("documents").select("doc_id", s.alias("score")).withColumn("band", X.band(F.col("score")))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10))[1:40], lambda x: trim(x) <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS digest FROM l""")
def snippets(t):
    """T5: the first 40 lines without blank ones."""
    s = X.snippet(F.col("text"))
    return t("documents").select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "\n").cast("binary")).alias("digest"))


@query("SELECT doc_id, regexp_matches(text, '(?i)(^|[^\\p{L}\\p{M}\\p{N}_])the([^\\p{L}\\p{M}\\p{N}_]|$)') AS hit FROM documents")
def column_match(t):
    """A column's name as a whole word."""
    return t("documents").select("doc_id", X.column_match("the", F.col("text")).alias("hit"))


_SQL = """SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_suppkey % 6 WHEN 0 THEN 'SELECT a FROM dbo.t' || l_partkey % 9 || ' JOIN [hr].[u] ON 1=1' WHEN 1 THEN 'insert into x.dbo.t' || l_partkey % 9 || ' (a) values (1)' WHEN 2 THEN ' UPDATE t' || l_partkey % 9 || ' SET a = 1'
 WHEN 3 THEN 'DELETE FROM t' || l_partkey % 9 || ' -- gone' WHEN 4 THEN 'WITH c AS (SELECT 1) SELECT * FROM c' ELSE 'usp_' || l_partkey END AS sql FROM lineitem"""


def _statements(t):
    k, n = F.col("l_suppkey") % 6, (F.col("l_partkey") % 9).cast("string")
    sql = (
        F.when(k == 0, F.concat(F.lit("SELECT a FROM dbo.t"), n, F.lit(" JOIN [hr].[u] ON 1=1"))).when(k == 1, F.concat(F.lit("insert into x.dbo.t"), n, F.lit(" (a) values (1)")))
        .when(k == 2, F.concat(F.lit(" UPDATE t"), n, F.lit(" SET a = 1"))).when(k == 3, F.concat(F.lit("DELETE FROM t"), n, F.lit(" -- gone")))
        .when(k == 4, "WITH c AS (SELECT 1) SELECT * FROM c").otherwise(F.concat(F.lit("usp_"), F.col("l_partkey").cast("string")))
    )
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), sql.alias("sql"))


@query(f"""WITH s AS ({_SQL}) SELECT id, CASE WHEN sql LIKE 'usp%' THEN 'UNKNOWN' WHEN upper(trim(sql)) LIKE 'WITH%' THEN 'SELECT' ELSE regexp_extract(upper(trim(sql)), '^(\\w+)', 1) END AS type,
 sql NOT LIKE 'usp%' AS kept, trim(regexp_replace(sql, '--.*$', '')) AS cleaned, CASE WHEN sql LIKE 'usp%' THEN '' ELSE regexp_extract(upper(trim(sql)), '^(\\w+)', 1) END AS keyword, sql LIKE 'usp%' AS hint FROM s""")
def classify_statements(t):
    """Statement types, kept statements and cleaned text."""
    s = F.col("sql")
    return _statements(t).select("id", X.sql_type(s).alias("type"), X.kept_statement(s).alias("kept"), X.clean_sql(s).alias("cleaned"), X.leading_keyword(s).alias("keyword"), X.procedure_hint(s).alias("hint"))


#: Statements and the tables that they name.
_TABLES = (
    ("SELECT a FROM dbo.t1 JOIN [hr].[u2] ON 1=1", "dbo.t1,hr.u2"),
    ("insert into x.dbo.T1(a, b) values (1)", "x.dbo.T1"),
    (" UPDATE t1 SET a = 1", "t1"),
    ("DELETE FROM t1 -- FROM gone", "t1"),
    ("WITH c AS (SELECT 1) SELECT * FROM c", ""),
    ("SELECT u.Id FROM PUR..Users u JOIN srv.PUR.dbo.Rows r ON 1=1", "PUR..Users,srv.PUR.dbo.Rows"),
    ("SELECT * FROM [Order Details] /* JOIN none */ d JOIN #t ON 1=1", "Order Details"),
    ("MERGE INTO dbo.t1 USING s2 ON 1=1 WHEN MATCHED THEN UPDATE SET a = 1", "dbo.t1,s2"),
    ("SELECT q.Id FROM OPENQUERY (LNK, 'x') q JOIN OPENJSON(@json) j ON 1=1", ""),
    ("usp_7", ""),
)


@query(f"""SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_partkey % {len(_TABLES)} {" ".join(f"WHEN {i} THEN '{found}'" for i, (_, found) in enumerate(_TABLES))} END AS tables FROM lineitem""")
def statement_tables(t):
    """tables that a statement names."""
    sql = F.element_at(F.array(*[F.lit(text) for text, _ in _TABLES]), (F.col("l_partkey") % len(_TABLES) + 1).cast("int"))
    return t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.array_join(X.tables(sql), ",").alias("tables"))


@query("""SELECT module_no, 'dbo.base' || module_no || ',hr.u' || (CASE WHEN module_no % 2 = 0 THEN ',log' || module_no ELSE '' END) AS tables FROM module""", "module")
def quick_tables(t):
    """tables of a module's body at a quick look."""
    m = F.col("module_no").cast("string")
    body = F.concat(F.lit("SELECT * FROM [dbo].[base"), m, F.lit("] b /* FROM no */ JOIN hr.u ON 1=1 -- JOIN none\nJOIN (SELECT 1) x ON 1=1 JOIN #t ON 1=1\n"), F.when(F.col("module_no") % 2 == 0, F.concat(F.lit("update log"), m, F.lit(" SET a = 1"))).otherwise("DELETE x"))
    return t("module").select("module_no", F.array_join(X.quick_tables(body), ",").alias("tables"))


@query("SELECT module_no, name, length(trim(name)) >= 3 AND (name LIKE 'usp_1%' OR name LIKE 'usp_2%') AS valid, CASE module_no % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS is_write FROM module", "module")
def name_predicates(t):
    """Procedure names and write access."""
    m = F.col("module_no") % 4
    access = F.when(m == 0, "insert").when(m == 1, "read").when(m == 2, "Write_Indirect").otherwise("SELECT")
    return t("module").select("module_no", "name", X.valid_procedure_name(F.col("name"), ("^usp_1", "^usp_2")).alias("valid"), X.is_write(access).alias("is_write"))


@query("SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'controller' WHEN 1 THEN 'service' WHEN 2 THEN 'razor_view' WHEN 3 THEN 'webforms' WHEN 4 THEN 'vue' ELSE 'other' END AS category, contains(lower(c_name), '00001') AS hit FROM customer")
def file_search(t):
    """Files of a program and their category."""
    k = F.col("c_custkey") % 6
    path = F.concat(F.when(k == 0, "a/Controllers/").when(k == 1, "a/Services/").otherwise("a/"), "c_name", F.when(k < 2, ".cs").when(k == 2, ".cshtml").when(k == 3, ".aspx").when(k == 4, ".vue").otherwise(".txt"))
    return t("customer").select("c_custkey", X.file_category(path).alias("category"), X.program_match(F.col("c_name"), "00001").alias("hit"))


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '([\\p{L}\\p{M}\\p{N}_]+)\\]?\\s*\\(', 1)) AS key FROM documents) SELECT DISTINCT w.doc_id AS id, m.name AS name FROM w JOIN (SELECT DISTINCT word AS name FROM module) m ON lower(m.name) = w.key""", "module")
def functions_called(t):
    """Names that stand before a parenthesis."""
    return resolve.names_called_in(t("documents").select(F.col("doc_id").alias("id"), "text"), t("module").select(F.col("word").alias("name")).distinct())


@query("SELECT p_partkey, lower(replace(p_name, ' ', '')) AS key FROM part")
def component_keys(t):
    """F19."""
    return t("part").select("p_partkey", X.component_key(F.translate("p_name", " ", "-")).alias("key"))


@query("SELECT p_partkey, CAST(1 + p_size % 2 AS INTEGER) AS code, 2 AS comment, 1 AS blank FROM part")
def line_counts(t):
    """Code, comment and blank lines."""
    text = F.concat(F.lit("int a; // x\n// c\n\n"), F.when(F.col("p_size") % 2 == 1, "b();\n").otherwise(""), F.lit("/* one */"))
    return t("part").select("p_partkey", X.line_counts(text).alias("c")).select("p_partkey", "c.code", "c.comment", "c.blank")
