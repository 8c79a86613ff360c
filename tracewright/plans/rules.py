"""Queries of matches, relations, screens, connections and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import access, aggregate, answers, graph, paths, rank
from tracewright.sources import config

from .registry import query


@query("""SELECT i.invocation_no AS call_id, i.procedure_name AS procedure, CASE WHEN i.invocation_no % 3 = 0 THEN i.database_name WHEN s.db IS NOT NULL THEN s.db ELSE 'unknown' END AS database_name FROM invocation i
 LEFT JOIN (SELECT s_suppkey AS c, 'src' || s_nationkey AS db FROM supplier WHERE s_suppkey % 3 = 0) s ON s.c = i.cust % 100 WHERE i.invocation_no % 2 = 0 OR (i.invocation_no % 5 = 1 AND i.invocation_no % 7 <> 0)""", "invocation")
def formal_procedures(t):
    """Formal procedure calls with their database."""
    i = F.col("invocation_no")
    calls = t("invocation").select(
        i.alias("call_id"), F.when(i % 2 == 0, "StoredProcedure").otherwise("Text").alias("command_type"), F.when(i % 5 == 1, "dapper").otherwise("raw").alias("kind"), F.when(i % 7 != 0, "stored_procedure").otherwise("inline").alias("mode"),
        F.col("procedure_name").alias("text"), F.when(i % 3 == 0, F.col("database_name")).otherwise("").alias("database"), (F.col("cust") % 100).alias("connection"),
    )
    sources = t("supplier").filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("connection"), F.concat(F.lit("src"), "s_nationkey").alias("database"))
    return access.project_calls(access.formal_calls(calls), sources)


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_suppkey % 4 WHEN 0 THEN 'PUR' WHEN 1 THEN 'other' ELSE '' END AS d, CASE l_suppkey % 3 WHEN 0 THEN 'dbo' WHEN 1 THEN 'Hr' ELSE '' END AS s, 'T' || l_partkey % 20 AS n, CASE WHEN l_linenumber % 2 = 0 THEN 'pur' ELSE '' END AS own FROM lineitem),
 y AS (SELECT *, CASE WHEN d <> '' THEN d ELSE own END AS held FROM x) SELECT id, s = '' AS unproven_schema, CASE WHEN own <> '' AND lower(held) <> own THEN held END AS stated_database FROM y WHERE n = 'T7' AND (held = '' OR lower(held) = 'pur') AND (s = '' OR lower(s) = 'hr')""")
def table_match(t):
    """Targets that answer a table question."""
    k, s, n = F.col("l_suppkey") % 4, F.col("l_suppkey") % 3, F.col("l_linenumber") % 2
    rows = t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(k == 0, "PUR").when(k == 1, "other").otherwise("").alias("database"), F.when(s == 0, "dbo").when(s == 1, "Hr").otherwise("").alias("schema"),
        F.concat(F.lit("T"), F.col("l_partkey") % 20).alias("name"), F.when(n == 0, "pur").otherwise("").alias("own"),
    )
    return access.table_match(rows, ("pur", "hr", "t7"), F.col("own")).select("id", "unproven_schema", "stated_database")


@query("""WITH v AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'conn' || c_nationkey ELSE 'CONN' || c_nationkey END AS name FROM customer), s AS (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'CONN' || s_nationkey ELSE 'conn' || s_nationkey END AS name, min(s_name) AS db FROM supplier GROUP BY 1),
 r AS (SELECT v.id, s.db, row_number() OVER (PARTITION BY v.id ORDER BY (v.name <> s.name), s.name) AS rn FROM v LEFT JOIN s ON lower(v.name) = lower(s.name)) SELECT id AS var_id, db AS database FROM r WHERE rn = 1""")
def connection_of_variable(t):
    """A variable's connection, by exact name first."""
    v = t("customer").select(F.col("c_custkey").alias("var_id"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "conn").otherwise("CONN"), "c_nationkey").alias("name"))
    s = t("supplier").select(F.concat(F.when(F.col("s_suppkey") % 3 == 0, "CONN").otherwise("conn"), "s_nationkey").alias("name"), F.col("s_name").alias("d")).groupBy("name").agg(F.min("d").alias("database"))
    return access.connection_of(v, s)


@query("""WITH r AS (SELECT DISTINCT 'f' || l_suppkey % 30 AS file, 'q' || l_partkey % 40 AS text, 't' || l_linenumber AS tbl FROM lineitem), p AS (SELECT DISTINCT file, text, 'p' || substr(text, 2) AS tbl FROM r WHERE CAST(substr(text, 2) AS INTEGER) % 4 = 0)
SELECT file, text, tbl, 'inline_sql_regex' AS reason FROM r WHERE (file, text) NOT IN (SELECT (file, text) FROM p) UNION ALL SELECT file, text, tbl, 'inline_sql_parsed' FROM p""")
def inline_relations(t):
    """Parsed texts replace what the patterns found."""
    r = t("lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey") % 30).alias("file"), F.concat(F.lit("q"), F.col("l_partkey") % 40).alias("text"), F.concat(F.lit("t"), "l_linenumber").alias("tbl")).distinct()
    p = r.filter(F.substring("text", F.lit(2), F.length("text")).cast("int") % 4 == 0).select("file", "text", F.concat(F.lit("p"), F.substring("text", F.lit(2), F.length("text"))).alias("tbl")).distinct()
    return access.parsed_over_regex(r, p)


@query("""WITH i AS (SELECT file AS path, module_no AS start, min(invocation_no) AS ord FROM invocation WHERE module_no % 3 <> 0 GROUP BY 1, 2) SELECT v.invocation_no, x.status AS evidence FROM invocation v LEFT JOIN i ON i.path = v.file AND i.start = v.module_no LEFT JOIN invocation x ON x.invocation_no = i.ord""", "invocation")
def rated_relations(t):
    """Relations with the evidence of their span's first invocation."""
    i = t("invocation")
    at = [F.col("file").alias("path"), F.col("module_no").alias("start"), (F.col("module_no") + 9).alias("end")]
    rated = i.filter("module_no % 3 <> 0").select(*at, F.col("invocation_no").alias("ord"), F.col("status").alias("evidence"))
    return access.rated_relations(i.select(*at, "invocation_no"), rated).select("invocation_no", "evidence")


@query("""SELECT DISTINCT p.p_partkey AS method_no FROM part p JOIN supplier s ON s.s_nationkey = p.p_partkey % 25 AND ('on' || s.s_suppkey % 9 = 'on' || p.p_size % 12 OR 'go' = 'on' || p.p_size % 12)""")
def event_handlers(t):
    """Methods that handle an event of the paired view."""
    m = t("part").select((F.col("p_partkey") % 25).alias("view"), F.concat(F.lit("on"), F.col("p_size") % 12).alias("method"), F.col("p_partkey").alias("method_no"))
    c = t("supplier").select(F.col("s_nationkey").alias("view"), F.create_map(F.lit("click"), F.concat(F.lit("on"), F.col("s_suppkey") % 9), F.lit("load"), F.lit("go")).alias("events"))
    return access.handled_events(m, c).select("method_no")


@query("""SELECT 'v' || doc_id AS name, md5(substr(text, 1, 8000)) AS digest FROM documents""")
def view_definitions(t):
    """Definitions of views among the tables used, cut at 8000 characters."""
    d = t("documents").select(F.concat(F.lit("v"), "doc_id").alias("name"), F.col("text").alias("definition"), "doc_id")
    return access.view_texts(d.select("name"), d.select("name", "definition")).select("name", F.md5(F.col("definition").cast("binary")).alias("digest"))


@query("""WITH c AS (SELECT 'Nation_' || n_nationkey AS controller FROM nation UNION ALL SELECT 'Nation_' || r_regionkey FROM region), o AS (SELECT controller FROM c GROUP BY 1 HAVING count(*) = 1)
SELECT c.c_custkey AS view, o.controller, s.s_suppkey AS action FROM customer c JOIN o ON lower(o.controller) = 'nation_' || c.c_nationkey JOIN supplier s ON 'Nation_' || s.s_nationkey = o.controller""")
def program_screens(t):
    """Screens of views by their controller."""
    name = lambda c: F.concat(F.lit("Nation_"), c).alias("controller")
    controllers = t("nation").select(name("n_nationkey")).union(t("region").select(name("r_regionkey")))
    actions = t("supplier").select(name("s_nationkey"), F.col("s_suppkey").alias("action"), F.col("s_name").alias("method"))
    views = t("customer").select(F.col("c_custkey").alias("view"), F.concat(F.lit("NATION_"), "c_nationkey").alias("folder"))
    return access.program_screens(views, controllers, actions).select("view", "controller", "action")


@query("""WITH a AS (SELECT s_nationkey AS controller, s_suppkey % 5 AS action, count(DISTINCT s_name) AS n, min(s_name) AS method FROM supplier GROUP BY 1, 2) SELECT c_custkey, CASE WHEN n = 1 THEN method END AS method FROM customer LEFT JOIN a ON controller = c_nationkey AND action = c_custkey % 5""")
def anchored_actions(t):
    """The method that an anchor names."""
    anchors = t("customer").select("c_custkey", F.col("c_nationkey").alias("controller"), (F.col("c_custkey") % 5).alias("action"))
    return access.anchored_actions(anchors, t("supplier").select(F.col("s_nationkey").alias("controller"), (F.col("s_suppkey") % 5).alias("action"), F.col("s_name").alias("method"))).select("c_custkey", "method")


@query("""WITH r AS (SELECT p_partkey % 30 AS file, p_partkey AS line, p_name AS reason FROM part WHERE p_partkey % 4 = 0), j AS (SELECT c_custkey, r.reason, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_custkey - r.line), r.line, r.reason) AS rn FROM customer JOIN r ON r.file = c_custkey % 30) SELECT c_custkey AS use_id, reason FROM j WHERE rn = 1""")
def nearest_reason(t):
    """The unresolved reason nearest by line."""
    uses = t("customer").select(F.col("c_custkey").alias("use_id"), (F.col("c_custkey") % 30).alias("file"), F.col("c_custkey").alias("line"))
    return access.nearest_reason(uses, t("part").filter("p_partkey % 4 = 0").select((F.col("p_partkey") % 30).alias("file"), F.col("p_partkey").alias("line"), F.col("p_name").alias("reason")))


@query("""WITH s AS (SELECT c_custkey AS site, c_nationkey % 3 AS origin, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' || c_custkey % 40 WHEN 2 THEN 'a/b' || c_custkey % 40 || '/c' ELSE 'z' || c_custkey END AS path FROM customer),
 j AS (SELECT s.site, p.site AS parent, length(p.path) AS l, max(length(p.path)) OVER (PARTITION BY s.site) AS m FROM s JOIN s p ON p.origin = s.origin AND starts_with(s.path, p.path || '/')),
 b AS (SELECT site, count(DISTINCT parent) AS n, min(parent) AS parent FROM j WHERE l = m GROUP BY 1) SELECT s.site, CASE WHEN n = 1 THEN parent END AS parent, CASE WHEN n > 1 THEN 'ambiguous' WHEN n = 1 THEN '' ELSE 'root' END AS reason FROM s LEFT JOIN b USING (site)""")
def parent_applications(t):
    """The application above a site."""
    c, k = F.col("c_custkey"), F.col("c_custkey") % 4
    b = F.concat(F.lit("a/b"), c % 40)
    path = F.when(k == 0, "a").when(k == 1, b).when(k == 2, F.concat(b, F.lit("/c"))).otherwise(F.concat(F.lit("z"), c))
    return access.parent_application(t("customer").select(c.alias("site"), (F.col("c_nationkey") % 3).alias("origin"), path.alias("path")))


@query("""WITH o AS (SELECT lower(p_name) AS name, p_partkey AS identity, p_size % 3 AS required, p_size % 5 AS declared FROM part), c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 9 THEN 'none' ELSE p_name END AS name, c_custkey % 5 AS n FROM customer JOIN part ON p_partkey = c_custkey % 200),
 f AS (SELECT c.id, o.name IS NOT NULL AS named, o.identity, CASE WHEN declared = n THEN 0 WHEN required <= n AND n < declared THEN 1 END AS fit FROM c LEFT JOIN o ON o.name = lower(c.name)), g AS (SELECT *, min(fit) OVER (PARTITION BY id) AS best FROM f),
 h AS (SELECT id, bool_or(named) AS named, count(*) FILTER (fit = best) AS n, min(identity) FILTER (fit = best) AS identity FROM g GROUP BY 1)
SELECT id AS call_id, CASE WHEN n = 1 THEN identity END AS identity, CASE WHEN NOT named THEN 'unresolved_method' WHEN n = 0 THEN 'no_matching_overload' WHEN n > 1 THEN 'ambiguous_overload' ELSE '' END AS reason FROM h""")
def overloads(t):
    """The overload that a call selects."""
    p, c = t("part"), F.col("c_custkey")
    ops = p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("identity"), (F.col("p_size") % 3).alias("required"), (F.col("p_size") % 5).alias("declared"))
    calls = t("customer").join(p, F.col("p_partkey") == c % 200).select(c.alias("call_id"), F.when(c % 10 == 9, "none").otherwise(F.upper("p_name")).alias("name"), (c % 5).alias("n_args"))
    return access.select_overload(calls, ops)


@query("""SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 3 = 0 EXCEPT ALL SELECT p_partkey, p_name FROM part WHERE p_partkey % 2 = 0""")
def environment_overrides(t):
    """Overrides that differ from the base settings."""
    p = t("part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value"))
    return access.overrides(p.filter("key % 2 = 0"), p.filter("key % 3 = 0"))


@query("""SELECT p_brand AS contract, sha256(string_agg(p_name || chr(30) || p_type || chr(30) || p_size, chr(31) ORDER BY p_name || chr(30) || p_type || chr(30) || p_size)) AS fingerprint FROM part GROUP BY 1""")
def contract_fingerprints(t):
    """A contract's fingerprint."""
    return access.contract_fingerprint(t("part").select(F.col("p_brand").alias("contract"), F.col("p_name").alias("identity"), F.col("p_type").alias("mode"), F.col("p_size").alias("required")))


@query("SELECT c_custkey AS call_id FROM customer WHERE c_nationkey % 5 = 0 OR c_custkey % 7 % 5 = 0")
def possible_callers(t):
    """Unresolved calls that may call what is reached."""
    calls = t("customer").select(F.col("c_custkey").alias("call_id"), F.array(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 7).alias("candidates"))
    return access.possible_callers(calls, t("nation").filter("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("long").alias("class_name")))


@query("""SELECT count(*) AS total, count(*) FILTER (invocation_no % 5 > 2) AS source, count(*) FILTER (invocation_no % 5 = 2) AS selected, count(*) FILTER (invocation_no % 5 = 1) AS ambiguous FROM invocation""", "invocation")
def wrapper_summary(t):
    """Wrapper totals."""
    i = F.col("invocation_no") % 5
    return access.wrapper_summary(t("invocation").select(F.when(i == 0, "not_applicable").when(i == 1, "ambiguous_overload").when(i == 2, "explicit_selected").otherwise("source_wrapper").alias("status")))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'List' ELSE 'Get' || c_nationkey END AS name, CASE c_custkey % 2 WHEN 0 THEN '/api/Order/Get' || c_nationkey ELSE '/x/y' END AS route FROM customer""")
def routes(t):
    """Action names and routes."""
    n, k = F.concat(F.lit("Get"), "c_nationkey"), F.col("c_custkey")
    name = access.action_name(F.concat(n, F.lit("Async")), F.when(k % 3 == 0, "List").otherwise(""))
    route = access.route(F.lit("api/[controller]"), F.when(k % 2 == 0, "[action]").otherwise("~/x/y"), F.lit("OrderController"), n)
    return t("customer").select("c_custkey", name.alias("name"), route.alias("route"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'dbo.p' || c_nationkey WHEN 1 THEN '[dbo].[q]' WHEN 2 THEN 'usp_' || c_nationkey ELSE '' END AS target FROM customer")
def embedded_targets(t):
    """the procedure that a command text executes."""
    k, n = F.col("c_custkey") % 4, F.col("c_nationkey")
    text = F.when(k == 0, F.concat(F.lit("SELECT 'EXEC no'; -- EXEC no\nexec @r = dbo.p"), n, F.lit(" @x = 1"))).when(k == 1, "EXECUTE AS USER = 'a'; EXECUTE [dbo].[q]").when(k == 2, F.concat(F.lit(" usp_"), n, F.lit(" "))).otherwise("UPDATE t SET a = 'EXEC p'")
    return t("customer").select("c_custkey", access.embedded_target(text).alias("target"))


@query("""SELECT file, module_no, min(invocation_no) AS invocation_no FROM invocation GROUP BY 1, 2""", "invocation")
def one_per_call_site(t):
    """The first invocation of each call site."""
    return rank.first_by(t("invocation").select("file", "module_no", "invocation_no"), ["file", "module_no"], F.col("invocation_no")).select("file", "module_no", "invocation_no")


@query("""SELECT l_orderkey, (SELECT string_agg(x, ',' ORDER BY f) FROM (SELECT x, min(p) AS f FROM (SELECT unnest(items) AS x, generate_subscripts(items, 1) AS p) GROUP BY x)) AS items FROM (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag) AS items FROM lineitem GROUP BY 1)""")
def ordered_unique(t):
    """Distinct items in the order of their first occurrence."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.filter(items, lambda x: x != "")), ",").alias("items"))


@query("""SELECT module_no, module_no % 2 = 0 OR module_no % 9 = 1 AS dynamic_sql, module_no % 3 = 0 AS temp_table, module_no % 5 = 0 AS cursor, module_no % 7 = 0 AS transaction, module_no % 11 < 6 AS receiver FROM module""", "module")
def module_flags(t):
    """What a definition contains, and types that can hold a connection."""
    m = F.col("module_no")
    part = lambda k, text: F.when(m % k == 0, text).otherwise("")
    text = F.concat_ws("\n", F.lit("SELECT 1; EXEC ('literal')"), part(2, "EXEC (@s)"), F.when(m % 9 == 1, "EXECUTE sp_executesql N'x'").otherwise(""), part(3, "SELECT a INTO #t FROM b"), part(5, "declare c CURSOR FOR SELECT 1"), part(7, "BEGIN TRAN"))
    kind = F.when(m % 11 == 0, "SqlConnection").when(m % 11 == 1, "AppDbContext").when(m % 11 == 2, "IDbConnection").when(m % 11 == 3, "OrderRepository").when(m % 11 < 6, "DapperContext").otherwise("StringBuilder")
    return t("module").select("module_no", X.flags(text).alias("f"), X.receiver_signal(kind).alias("receiver")).select("module_no", "f.dynamic_sql", "f.temp_table", "f.cursor", "f.transaction", "receiver")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS source, CAST(floor(c_custkey / 2) AS BIGINT) AS target FROM customer UNION ALL SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 10 = 0),
 r AS (SELECT c_custkey AS origin, c_custkey AS node FROM customer UNION SELECT r.origin, e.target FROM r JOIN e ON e.source = r.node) SELECT origin, node FROM r""")
def shared_components(t):
    """Partial views that a view holds, each once; some hold each other."""
    c = F.col("c_custkey")
    edges = t("customer").select(c.alias("source"), F.floor(c / 2).cast("long").alias("target")).union(t("customer").filter(c % 10 == 0).select(c, c + 1))
    return graph.reach(t("customer").select(c.alias("origin"), c.alias("node")), edges).select("origin", "node")


@query("""SELECT o_orderkey AS access_id, 's' || s_suppkey AS base, 'READ_INDIRECT' AS access_type FROM orders JOIN supplier ON s_nationkey = o_custkey % 40""")
def inline_lineage(t):
    """Base tables behind a view that inline SQL reads."""
    reads = t("orders").select(F.col("o_orderkey").alias("access_id"), F.concat(F.lit("v"), F.col("o_custkey") % 40).alias("target"))
    lineage = t("supplier").select(F.concat(F.lit("v"), "s_nationkey").alias("container"), F.concat(F.lit("s"), "s_suppkey").alias("base"))
    return paths.with_lineage(reads, lineage).select("access_id", "base", "access_type")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'missing' WHEN o_custkey % 3 = 0 THEN 'stale' ELSE 'current' END AS source_state FROM orders WHERE o_orderkey % 50 = 7""")
def path_evidence(t):
    """A path with the state of its source file."""
    f = F.concat(F.lit("f"), "o_custkey").alias("file")
    records = t("orders").select("o_orderkey", f, F.when(F.col("o_orderkey") % 50 == 7, "P-1").otherwise("P-2").alias("path_id"))
    snapshots = t("orders").select(f, F.lit("a").alias("hash"), F.when(F.col("o_custkey") % 5 == 0, None).when(F.col("o_custkey") % 3 == 0, "b").otherwise("a").alias("read_hash")).distinct()
    return answers.path_evidence(records, "P-1", snapshots).select("o_orderkey", "source_state")


@query("""WITH e AS (SELECT s_nationkey AS path, s_suppkey % 4 AS key, s_name AS value, s_suppkey AS ord, s_suppkey % 9 = 4 AS stops, s_suppkey % 27 = 4 AS every FROM supplier),
 l AS (SELECT a.path, a.key, a.value, a.ord FROM e a WHERE NOT a.stops AND NOT EXISTS (SELECT 1 FROM e b WHERE b.stops AND b.path = a.path AND b.ord > a.ord AND (b.every OR b.key = a.key)))
SELECT path, CAST(key AS VARCHAR) AS key, max_by(value, ord) AS value FROM l GROUP BY 1, 2""")
def settings_in_force(t):
    """Entries left after ordered removes and clears."""
    s = F.col("s_suppkey")
    entries = t("supplier").select(F.col("s_nationkey").alias("path"), F.lit("app_settings").alias("namespace"), F.when(s % 27 == 4, "*").otherwise((s % 4).cast("string")).alias("key"), F.col("s_name").alias("value"), s.alias("ord"), (s % 9 == 4).alias("stops"))
    return config.table(entries).select("path", "key", "value")


@query("""WITH r AS (SELECT n_regionkey AS resource, n_nationkey AS key, n_name AS value FROM nation WHERE n_regionkey <> 3), f AS (SELECT c_custkey AS field, c_custkey % 6 AS resource, c_nationkey AS key FROM customer)
SELECT field, r.value AS text, CASE WHEN f.resource NOT IN (SELECT resource FROM r) THEN 'resource_file_not_found' WHEN r.value IS NULL THEN 'resource_key_not_found' ELSE '' END AS reason FROM f LEFT JOIN r ON r.resource = f.resource AND r.key = f.key""")
def display_texts(t):
    """Display texts of fields, or why there is none."""
    resources = t("nation").filter("n_regionkey <> 3").select(F.col("n_regionkey").cast("long").alias("resource"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    return config.display_text(t("customer").select(F.col("c_custkey").alias("field"), (F.col("c_custkey") % 6).alias("resource"), F.col("c_nationkey").alias("key")), resources)


@query("""SELECT n_nationkey AS system, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'cloned' END AS clone, CASE WHEN s.n IS NULL THEN 'missing' WHEN s.old > 0 THEN 'outdated' ELSE 'current' END AS scan FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n, count(*) FILTER (s_suppkey % 6 = 0) AS old FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def data_status(t):
    """Clone and scan state of each system."""
    scans = t("supplier").select(F.col("s_nationkey").alias("system"), (F.col("s_suppkey") % 6 == 0).alias("outdated"))
    clones = t("nation").filter("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("system"))
    return aggregate.data_status(t("nation").select(F.col("n_nationkey").alias("system")), clones, scans)
