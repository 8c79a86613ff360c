"""Parsers and catalogs over text made of the star schema, and composed answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import lexing, pages, tsql
from tracewright.operators import answers, build, evidence
from tracewright.sources import catalog, config

from .lineage import _EDGE, _PATHS, _methods, _records
from .registry import query

_OPS = "o AS (SELECT DISTINCT module_no, operation_no, operation_type, target FROM operation)"


@query(f"""WITH {_OPS} SELECT module_no, row_number() OVER (PARTITION BY module_no ORDER BY operation_no, operation_type, target) AS sequence, operation_type, CASE WHEN operation_type = 'SELECT' THEN target ELSE '' END AS reads,
 CASE WHEN operation_type <> 'SELECT' THEN target ELSE '' END AS writes, CASE WHEN operation_type <> 'INSERT' THEN 'k = ' || operation_no ELSE '' END AS condition, CASE WHEN operation_type IN ('INSERT', 'UPDATE') THEN 'a' ELSE '' END AS columns FROM o""", "operation")
def tsql_operations(t):
    """X8, round trip: procedures rendered from the operations and parsed back."""
    k, n = F.col("operation_type"), F.col("operation_no").cast("string")
    s = (
        F.when(k == "SELECT", F.concat(F.lit("SELECT * FROM dbo.["), "target", F.lit("] AS x /* FROM no */ WHERE k = "), n))
        .when(k == "INSERT", F.concat(F.lit("INSERT INTO dbo."), "target", F.lit(" (a) VALUES ("), n, F.lit(")")))
        .when(k == "UPDATE", F.concat(F.lit("UPDATE x SET x.a = 'FROM it' FROM dbo."), "target", F.lit(" x WHERE k = "), n))
        .otherwise(F.concat(F.lit("DELETE FROM dbo."), "target", F.lit(" WHERE k = "), n))
    )
    o = t("operation").select("module_no", "operation_no", "operation_type", "target").distinct()
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("operation_no", "operation_type", "target", s.alias("s")))), lambda x: x["s"]), "\n-- next\n")
    modules = o.groupBy("module_no").agg(F.concat(F.lit("CREATE PROCEDURE dbo.p @k int AS BEGIN "), body, F.lit(" END")).alias("definition")).select(F.col("module_no").cast("string").alias("module_id"), "definition")
    got = tsql.operations(modules)
    name = lambda c: F.coalesce(F.get(c, 0)["name"], F.lit(""))
    return got.select(
        F.col("module_id").cast("long").alias("module_no"), F.col("sequence").cast("long").alias("sequence"), "operation_type", name("read_tables").alias("reads"), name("write_tables").alias("writes"),
        F.col("where").alias("condition"), F.array_join("written_columns", ",").alias("columns"),
    )


_BUILT = """o AS (SELECT DISTINCT module_no, operation_no, operation_type, target FROM operation), l AS (SELECT module_no, name, CASE WHEN schema_name = '' THEN 'dbo' ELSE schema_name END AS s FROM module),
 st AS (SELECT l.module_no, l.s, 'stored_procedure:' || l.s || '.' || l.name AS module_id, o.*, row_number() OVER (PARTITION BY l.module_no ORDER BY operation_no, operation_type, o.target) + (SELECT count(*) FROM call c WHERE c.source = l.module_no) AS seq FROM l JOIN o ON o.module_no = l.module_no),
 ac AS (SELECT 'dml_operation:' || module_id || ':' || seq AS op, module_id, s, operation_type, operation_no % 4 AS form, CAST(substr(target, 3) AS BIGINT) AS no, target FROM st),
 tg AS (SELECT *, CASE WHEN form = 0 THEN 'dbo' WHEN form = 1 THEN 'dbo' WHEN form = 2 THEN 'hr' ELSE '' END AS schema, CASE WHEN form = 1 AND s = 'dbo' THEN 'module_schema' WHEN form = 1 THEN 'default_schema' WHEN form = 3 THEN 'unresolved' ELSE 'written' END AS source FROM ac),
 ta AS (SELECT *, CASE WHEN schema = 'dbo' AND no % 5 = 0 THEN 'view:' ELSE 'table:' END || schema || '.' || target AS node FROM tg),
 ca AS (SELECT DISTINCT m.s, 'stored_procedure:' || m.s || '.' || m.name AS module_id, c.target, k.s AS held, 'usp_' || c.target AS called FROM call c JOIN l m ON m.module_no = c.source LEFT JOIN l k ON k.module_no = c.target),
 cb AS (SELECT *, CASE WHEN held = s THEN 'module_schema' WHEN held = 'dbo' THEN 'default_schema' ELSE 'unresolved' END AS source FROM ca)"""


@query(f"""WITH {_BUILT} SELECT 'contains' AS type, module_id AS source, op AS target, '' AS schema_source, '' AS database FROM ta
UNION ALL SELECT CASE WHEN operation_type = 'SELECT' THEN 'reads' ELSE 'writes' END, op, node, source, CASE WHEN form = 3 THEN 'other' ELSE '' END FROM ta
UNION ALL SELECT DISTINCT 'uses', module_id, node, source, CASE WHEN form = 3 THEN 'other' ELSE '' END FROM ta WHERE operation_type = 'SELECT' AND node LIKE 'view%'
UNION ALL SELECT 'calls', module_id, 'stored_procedure:' || CASE source WHEN 'module_schema' THEN s WHEN 'default_schema' THEN 'dbo' ELSE '' END || '.' || called, source, '' FROM cb""", "module", "call", "operation")
def graph_edges(t):
    """Relationships of a graph built from the text of every module."""
    return _built(t).edges.select("type", "source", "target", "schema_source", "database").distinct()


@query(f"""WITH {_BUILT} SELECT node_id, type FROM (SELECT 'stored_procedure:' || s || '.' || name AS node_id, 'stored_procedure' AS type FROM l UNION SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'view' ELSE 'table' END || ':dbo.t_' || s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'view' ELSE 'table' END FROM supplier
 UNION SELECT op, 'dml_operation' FROM ta UNION SELECT node, 'table' FROM ta WHERE node LIKE 'table%')""", "module", "call", "operation")
def graph_nodes(t):
    """G1: nodes of that graph, with tables that nobody listed."""
    return _built(t).nodes.select("node_id", "type")


def _built(t):
    """Procedures rendered from the calls and operations, tables and views from the suppliers, as one database's graph."""
    k, n, form = F.col("operation_type"), F.col("operation_no").cast("string"), F.col("operation_no") % 4
    name = F.when(form == 0, F.concat(F.lit("[dbo].["), "target", F.lit("]"))).when(form == 1, F.col("target")).when(form == 2, F.concat(F.lit("hr."), "target")).otherwise(F.concat(F.lit("other.."), "target"))
    s = (
        F.when(k == "SELECT", F.concat(F.lit("SELECT * FROM "), name, F.lit(" AS x WHERE k = "), n)).when(k == "INSERT", F.concat(F.lit("INSERT INTO "), name, F.lit(" (a) VALUES ("), n, F.lit(")")))
        .when(k == "UPDATE", F.concat(F.lit("UPDATE "), name, F.lit(" SET a = 1 WHERE k = "), n)).otherwise(F.concat(F.lit("DELETE FROM "), name, F.lit(" WHERE k = "), n))
    )
    ops = t("operation").select("module_no", "operation_no", "operation_type", "target").distinct().groupBy("module_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("operation_no", "operation_type", "target", s.alias("s")))), lambda x: x["s"]), ";\n").alias("body"))
    calls = t("call").groupBy(F.col("source").alias("module_no")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("target")), lambda c: F.concat(F.lit("EXEC usp_"), c.cast("string"))), ";\n").alias("calls"))
    modules = t("module").join(calls, "module_no", "left").join(ops, "module_no", "left")
    text = F.concat(F.lit("CREATE PROCEDURE p AS BEGIN "), F.coalesce(F.concat("calls", F.lit(";\n")), F.lit("")), F.coalesce("body", F.lit("")), F.lit(" END"))
    procedures = modules.select(F.lit("stored_procedure").alias("type"), F.col("schema_name").alias("schema"), "name", text.alias("definition"))
    suppliers = t("supplier").select(F.when(F.col("s_suppkey") % 5 == 0, "view").otherwise("table").alias("type"), F.lit("dbo").alias("schema"), F.concat(F.lit("t_"), "s_suppkey").alias("name"), F.lit(None).cast("string").alias("definition"))
    return build.build(procedures.unionByName(suppliers), "main")


@query("SELECT s_suppkey, 'srv' || s_nationkey AS server, CASE WHEN s_suppkey % 2 = 0 THEN 'db=' || s_suppkey ELSE '' END AS database FROM supplier")
def connection_strings(t):
    """Server and database of connection strings."""
    text = F.concat(F.lit(" Data Source = srv"), "s_nationkey", F.lit(";User ID=sa;Password=x;"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Initial Catalog=db="), "s_suppkey", F.lit(";Database=other"))).otherwise(""))
    c = t("supplier").select("s_suppkey", config.connection_parts(text).alias("c"))
    return c.select("s_suppkey", "c.server", "c.database")


@query("""SELECT 'procedures' AS kind, CASE WHEN p_size % 5 = 0 THEN 'dbo' WHEN p_size % 5 = 1 THEN 'hr' ELSE 'app' END AS schema, p_name AS name FROM part WHERE p_size % 5 NOT IN (2, 3) AND p_partkey % 11 <> 0
UNION ALL SELECT 'tables', 'dbo', s_name FROM supplier WHERE s_suppkey % 11 <> 0""")
def object_listing(t):
    """Listed objects without shipped ones and system schemas."""
    z = F.col("p_size") % 5
    schema = F.when(z == 0, "dbo").when(z == 1, "hr").when(z == 2, "SYS").when(z == 3, "db_owner").otherwise("app")
    p = t("part").select(schema.alias("schema"), F.col("p_name").alias("name"), (F.col("p_partkey") % 11 == 0).alias("is_shipped"))
    return catalog.listing({"procedures": p, "tables": t("supplier").select(F.lit("dbo").alias("schema"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 11 == 0).alias("is_shipped"))})


@query("SELECT doc_id AS key, md5(text) AS digest FROM documents")
def full_definitions(t):
    """Definitions that may be cut are taken from the full text."""
    d = t("documents").select(F.col("doc_id").alias("key"), F.col("text").alias("definition"))
    return catalog.definitions(d.withColumn("definition", F.substring("definition", 1, 4000)), d).select("key", F.md5(F.col("definition").cast("binary")).alias("digest"))


@query("SELECT l_orderkey AS key, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1")
def ordered_columns(t):
    """Parameters and columns in their order."""
    got = catalog.in_order(t("lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("value")), "key", "ordinal", "value")
    return got.select("key", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query("""WITH d AS (SELECT l_partkey AS module, 't' || l_suppkey AS entity, CASE WHEN l_linenumber > 2 THEN 'c' || l_linenumber END AS minor, l_returnflag = 'R' AS sel, l_returnflag = 'A' AS upd FROM lineitem)
SELECT module, coalesce(string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (minor IS NULL AND sel), '') AS reads, coalesce(string_agg(DISTINCT entity, ',' ORDER BY entity) FILTER (minor IS NULL AND upd), '') AS writes,
 coalesce(string_agg(DISTINCT minor, ',' ORDER BY minor) FILTER (minor IS NOT NULL AND upd), '') AS written_columns FROM d GROUP BY 1""")
def native_dependencies(t):
    """Tables read and written by referenced entities."""
    rows = t("lineitem").select(
        F.col("l_partkey").alias("module"), F.concat(F.lit("t"), "l_suppkey").alias("entity"), F.when(F.col("l_linenumber") > 2, F.concat(F.lit("c"), "l_linenumber")).alias("minor"),
        (F.col("l_returnflag") == "R").alias("is_selected"), (F.col("l_returnflag") == "A").alias("is_updated"),
    )
    got = catalog.dependencies(rows)
    return got.select("module", *[F.array_join(c, ",").alias(c) for c in ("reads", "writes", "written_columns")])


@query("SELECT p_partkey, 'SELECT ''--'' FROM t' || p_size || '  ;' AS text FROM part")
def sql_comments(t):
    """SQL text without comments."""
    sql = F.concat(F.lit("SELECT '--' FROM t"), "p_size", F.lit(" /* a /* b */ c */;-- end"))
    return t("part").select("p_partkey", lexing.sql_without_comments(sql).alias("text")).withColumn("text", F.regexp_replace("text", r" +;", "  ;")).withColumn("text", F.rtrim("text"))


@query("""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"/]+)/([^"/?#\\s'']+)[^"\\s'']*"', 0)) AS x FROM pages) SELECT CAST(page_id AS VARCHAR) AS path, regexp_extract(x, '<a href="/([^"/]+)/([^"/?#\\s'']+)', 2) AS name, regexp_extract(x, '<a href="/([^"/]+)/', 1) AS detail FROM a""")
def razor_anchors(t):
    """Candidate anchors of the pages."""
    files = t("pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return pages.facts(files, "razor").filter("kind = 'anchor' and strength = 'candidate'").select("path", "name", "detail")


@query("""WITH i AS (SELECT *, CASE invocation_no % 5 WHEN 0 THEN 'not_applicable' WHEN 1 THEN 'ambiguous_overload' WHEN 2 THEN 'explicit_selected' ELSE 'source_wrapper' END AS st, invocation_no % 3 = 0 AS src, invocation_no % 4 <> 0 AS sink,
 CASE invocation_no % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'inline' ELSE 'stored_procedure' END AS mode, invocation_no % 2 = 0 AS lit FROM invocation)
SELECT invocation_no, CASE WHEN st = 'not_applicable' THEN NULL WHEN NOT src AND st = 'ambiguous_overload' THEN 'ambiguous_overload' WHEN NOT src AND st = 'explicit_selected' AND NOT sink THEN 'wrapper_contract_sink_unresolved'
 WHEN NOT src AND st = 'explicit_selected' AND mode = 'unknown' THEN 'wrapper_mode_unresolved' WHEN NOT src AND st = 'explicit_selected' AND mode = 'inline' AND lit THEN 'inline_sql' WHEN NOT src AND st = 'explicit_selected' AND lit THEN ''
 WHEN NOT src THEN 'wrapper_source_unavailable' WHEN NOT sink THEN 'terminal_sink_unresolved' WHEN mode = 'unknown' THEN 'command_type_unresolved' WHEN NOT lit THEN 'dynamic_command_text' ELSE '' END AS reason FROM i""", "invocation")
def wrapper_gates(t):
    """Section 2.13: gates of wrapper calls."""
    i = F.col("invocation_no")
    status = F.when(i % 5 == 0, "not_applicable").when(i % 5 == 1, "ambiguous_overload").when(i % 5 == 2, "explicit_selected").otherwise("source_wrapper")
    mode = F.when(i % 7 == 0, "unknown").when(i % 7 == 1, "inline").otherwise("stored_procedure")
    return t("invocation").select("invocation_no", evidence.wrapper_gate(status, i % 3 == 0, i % 4 != 0, mode, i % 2 == 0).alias("reason"))


@query("SELECT invocation_no, invocation_no % 4 <= invocation_no % 3 AS compatible FROM invocation WHERE invocation_no % 4 <= invocation_no % 3 UNION ALL SELECT invocation_no, true FROM invocation WHERE invocation_no % 4 > invocation_no % 3 AND invocation_no % 2 = 0 UNION ALL SELECT invocation_no, invocation_no % 3 = 0 FROM invocation WHERE invocation_no % 4 > invocation_no % 3 AND invocation_no % 2 = 1", "invocation")
def branch_compatibility(t):
    """Whether one branch context is a prefix of the other."""
    i = F.col("invocation_no")
    full = F.array(F.lit("if (a)"), F.lit("else (b)"), F.lit("when (c)"))
    other = F.array(F.lit("x"), F.lit("y"), F.lit("z"))
    a = F.slice(full, F.lit(1), (i % 4).cast("int"))
    b = F.when((i % 4 > i % 3) & (i % 2 == 1), F.slice(other, F.lit(1), (i % 3).cast("int"))).otherwise(F.slice(full, F.lit(1), (i % 3).cast("int")))
    return t("invocation").select("invocation_no", evidence.branch_compatible(a, b).alias("compatible"))


@query(f"""WITH RECURSIVE {_EDGE}, r AS (SELECT module_no AS origin, module_no AS node, 0 AS depth FROM module UNION SELECT r.origin, e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node),
 m AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2), o AS (SELECT module_no, count(DISTINCT (target, operation_type)) AS touched FROM operation GROUP BY 1)
SELECT origin, node, CAST(depth AS INTEGER) AS depth, touched FROM m JOIN o ON o.module_no = m.node""", "module", "method_call", "operation")
def flow_forward(t):
    """What an entry reaches and touches."""
    ops = t("operation").withColumnRenamed("module_no", "module")
    found = answers.flow_forward(t("module").select(F.col("module_no").alias("node")), _methods(t), ops)
    return found.groupBy("origin", "node", "depth").agg(F.count("*").alias("touched"))


@query(f"""WITH RECURSIVE {_EDGE}, r AS (SELECT DISTINCT module_no AS origin, module_no AS node, 0 AS depth FROM operation WHERE target = 't_3' UNION SELECT r.origin, e.source, r.depth + 1 FROM r JOIN e ON e.target = r.node),
 m AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2) SELECT 'page' || (node % 50) AS screen, CAST(min(depth) AS INTEGER) AS depth, count(DISTINCT origin) AS touching FROM m GROUP BY 1""", "method_call", "operation")
def flow_backward(t):
    """Screens from which a table is reached."""
    ops = t("operation").withColumnRenamed("module_no", "module")
    screens = t("module").select(F.concat(F.lit("page"), F.col("module_no") % 50).alias("screen"), F.col("module_no").alias("node"))
    return answers.flow_backward("T_3", ops, _methods(t), screens)


@query(f"""WITH RECURSIVE {_PATHS}, g AS (SELECT DISTINCT file FROM invocation), i AS (SELECT file, count(*) AS invocations, count(*) FILTER (status = 'F') AS proven FROM invocation GROUP BY 1),
 pp AS (SELECT file, count(*) AS paths, count(DISTINCT CASE WHEN operation_type IN ('INSERT', 'UPDATE', 'DELETE', 'MERGE') THEN target END) AS written_tables FROM r GROUP BY 1)
SELECT g.file, coalesce(invocations, 0) AS invocations, coalesce(proven, 0) AS proven, coalesce(paths, 0) AS paths, coalesce(written_tables, 0) AS written_tables FROM g LEFT JOIN i USING (file) LEFT JOIN pp USING (file)""", "module", "call", "operation", "invocation")
def analyze_programs(t):
    """API analyze: facts of each program."""
    i = t("invocation").withColumn("evidence", F.when(F.col("status") == "F", "proven").otherwise("unresolved"))
    return answers.analyze(i.select("file").distinct(), i, _records(t))
