"""Names, resolution, catalogs and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import names as N
from tracewright.operators import aggregate, evidence, resolve

from .registry import query

_WRITTEN = """SELECT module_no, CASE module_no % 5 WHEN 0 THEN name WHEN 1 THEN concat('[Hr].[', name, ']') WHEN 2 THEN concat(' [Db1] . dbo . ', name)
  WHEN 3 THEN concat('srv.', database_name, '..', upper(name)) ELSE concat('x.srv.Db2.DBO.', name) END AS written FROM module"""


def _written(m):
    n = F.col("module_no") % 5
    return m.select(
        "module_no",
        F.when(n == 0, F.col("name")).when(n == 1, F.concat(F.lit("[Hr].["), "name", F.lit("]"))).when(n == 2, F.concat(F.lit(" [Db1] . dbo . "), "name"))
        .when(n == 3, F.concat(F.lit("srv."), "database_name", F.lit(".."), F.upper("name"))).otherwise(F.concat(F.lit("x.srv.Db2.DBO."), "name")).alias("written"),
    )


@query(f"""WITH w AS ({_WRITTEN}), s AS (SELECT module_no, written, string_split(replace(replace(written, '[', ''), ']', ''), '.') AS p FROM w),
 q AS (SELECT module_no, coalesce(trim(p[-4]), '') AS server, coalesce(trim(p[-3]), '') AS database, coalesce(trim(p[-2]), '') AS schema, trim(p[-1]) AS name FROM s)
SELECT module_no, server, database, schema, name, lower(name) AS bare_key, lower(database) || '.' || lower(schema) || '.' || lower(name) AS full_key,
  CASE WHEN schema <> '' AND name <> '' THEN schema || '.' || name ELSE name END AS qualified FROM q""", "module")
def names_parse(t):
    """parts and keys of written names."""
    p = _written(t("module")).withColumn("p", N.parse(F.col("written")))
    k = N.ascii_key
    return p.select("module_no", "p.server", "p.database", "p.schema", "p.name", N.bare_key(F.col("p"), k).alias("bare_key"), N.full_key(F.col("p"), k).alias("full_key"), N.schema_qualified(F.col("p")).alias("qualified"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'host' || c_nationkey || '.corp.local' WHEN c_custkey % 3 = 1 THEN 'db' || c_nationkey || '.corp.local' ELSE 'a.b' || c_nationkey END AS server_key FROM customer""")
def names_server_key(t):
    """cache keys of servers."""
    n, k = F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3
    written = F.when(k == 0, F.concat(F.lit("tcp:HOST"), n, F.lit(",1433"))).when(k == 1, F.concat(F.lit(" Db"), n, F.lit("\\SQLEXPRESS"))).otherwise(F.concat(F.lit("A.B"), n))
    return t("customer").select("c_custkey", N.server_key(written, ".corp.local").alias("server_key"))


@query("""SELECT 'procedure' AS kind, word AS key, string_agg(DISTINCT schema_name, ',' ORDER BY schema_name) AS schemas, count(DISTINCT schema_name) AS n
FROM module GROUP BY word HAVING count(DISTINCT schema_name) > 1""", "module")
def name_collisions(t):
    """Names in more than one schema."""
    return aggregate.collisions(t("module").select(F.lit("procedure").alias("kind"), F.col("word").alias("key"), F.col("schema_name").alias("schema")))


_REF = """ref AS (SELECT invocation_no AS ref_id, CASE WHEN invocation_no % 11 = 0 THEN 'db9' ELSE '' END AS database, CASE WHEN invocation_no % 4 = 0 THEN 'hr' ELSE '' END AS schema,
 CASE WHEN invocation_no % 13 = 0 THEN 'sp_' || module_no ELSE procedure_name END AS key, CASE invocation_no % 3 WHEN 0 THEN 'hr' WHEN 1 THEN 'dbo' ELSE '' END AS module_schema FROM invocation)"""


def _references(t):
    i = F.col("invocation_no")
    return t("invocation").select(
        i.alias("ref_id"), F.when(i % 11 == 0, "db9").otherwise("").alias("database"), F.when(i % 4 == 0, "hr").otherwise("").alias("schema"),
        F.when(i % 13 == 0, F.concat(F.lit("sp_"), "module_no")).otherwise(F.col("procedure_name")).alias("key"),
        F.when(i % 3 == 0, "hr").when(i % 3 == 1, "dbo").otherwise("").alias("module_schema"),
    )


@query(f"""WITH {_REF}, h AS (SELECT r.*, EXISTS (SELECT 1 FROM module m WHERE m.name = r.key AND m.schema_name = r.module_schema AND m.schema_name <> '') AS im,
  EXISTS (SELECT 1 FROM module m WHERE m.name = r.key AND m.schema_name = 'dbo') AS idb FROM ref r),
 s AS (SELECT *, CASE WHEN schema <> '' THEN 'written' WHEN database <> '' THEN 'unresolved' WHEN module_schema <> '' AND im THEN 'module_schema' WHEN idb THEN 'default_schema'
   WHEN key LIKE 'sp\\_%' ESCAPE '\\' THEN 'system' ELSE 'unresolved' END AS schema_source FROM h)
SELECT ref_id, CASE schema_source WHEN 'written' THEN schema WHEN 'module_schema' THEN module_schema WHEN 'default_schema' THEN 'dbo' WHEN 'system' THEN 'sys' ELSE '' END AS resolved_schema, schema_source FROM s""", "module", "invocation")
def resolve_schema(t):
    """Schema of each call, by the listing."""
    listing = t("module").select(F.col("schema_name").alias("schema"), F.col("name").alias("key"))
    return resolve.resolve_schema(_references(t), listing, calls=True)


@query("""WITH i AS (SELECT invocation_no AS invocation_id, word AS key, CASE WHEN invocation_no % 2 = 0 THEN 'hr' ELSE '' END AS schema FROM invocation JOIN module USING (module_no)),
 n AS (SELECT module_no AS node_id, word AS key, schema_name AS schema FROM module),
 j AS (SELECT i.invocation_id, count(n.node_id) AS n, min(n.node_id) AS least FROM i LEFT JOIN n ON i.key = n.key AND (i.schema = '' OR n.schema = '' OR i.schema = n.schema) GROUP BY 1)
SELECT invocation_id, CASE WHEN n = 1 THEN least END AS node_id, n, CASE WHEN n = 0 THEN 'stored_procedure_not_in_graph' WHEN n > 1 THEN 'ambiguous_stored_procedure_graph_target' ELSE '' END AS reason FROM j""", "invocation", "module")
def match_procedure(t):
    """Invocations and the one procedure node they name."""
    m = t("module")
    i = t("invocation").join(m.select("module_no", "word"), "module_no").select(F.col("invocation_no").alias("invocation_id"), F.col("word").alias("key"), F.when(F.col("invocation_no") % 2 == 0, "hr").otherwise("").alias("schema"))
    nodes = m.select(F.col("module_no").alias("node_id"), F.col("word").alias("key"), F.col("schema_name").alias("schema"))
    return resolve.match_procedure(i, nodes)


@query(f"""WITH {_REF}, cat AS (SELECT database_name, schema_name, name FROM module WHERE module_no % 7 <> 0), cmd AS (SELECT ref_id, concat('db', ref_id % 4) AS database, schema, key FROM ref),
 j AS (SELECT ref_id, any_value(schema) AS schema, count(c.name) AS n, count(*) FILTER (c.schema_name = cmd.schema) AS e, count(*) FILTER (c.schema_name = '') AS l
   FROM cmd LEFT JOIN cat c ON c.database_name = cmd.database AND c.name = cmd.key GROUP BY ref_id),
 r AS (SELECT ref_id, CASE WHEN n = 0 THEN NULL WHEN schema <> '' AND e > 0 THEN '' WHEN schema = '' OR l > 0 THEN 'unproven_schema' END AS reason FROM j)
SELECT ref_id AS command_id, reason, reason IS NOT NULL AS in_catalog FROM r""", "module", "invocation")
def catalog_match(t):
    """Commands against the procedure catalog."""
    catalog = t("module").filter("module_no % 7 <> 0").select(F.col("database_name").alias("database"), F.col("schema_name").alias("schema"), F.col("name").alias("key"))
    commands = _references(t).select(F.col("ref_id").alias("command_id"), F.concat(F.lit("db"), F.col("ref_id") % 4).alias("database"), "schema", "key")
    return resolve.catalog_match(commands, catalog)


@query("""SELECT word AS key, count(DISTINCT database_name) FILTER (module_no % 3 = 0) AS n_databases, coalesce(string_agg(DISTINCT database_name, ',' ORDER BY database_name) FILTER (module_no % 3 = 0), '') AS databases FROM module GROUP BY word""", "module")
def databases_holding(t):
    """Databases that hold a name."""
    m = t("module")
    return resolve.databases_holding(m.select(F.col("word").alias("key")), m.filter("module_no % 3 = 0").select(F.col("word").alias("key"), F.col("database_name").alias("database")))


@query("""WITH l AS (SELECT c_custkey AS lookup_id, c_nationkey AS key FROM customer), y AS (SELECT s_suppkey % 5 AS layer, s_nationkey AS key, s_name AS value, s_suppkey % 6 = 0 AS stops FROM supplier),
 a AS (SELECT lookup_id, min(struct_pack(layer := layer, value := value)) FILTER (NOT stops) AS held, min(layer) FILTER (stops) AS stop FROM l LEFT JOIN y USING (key) GROUP BY lookup_id)
SELECT lookup_id, CASE WHEN held IS NOT NULL AND (stop IS NULL OR held.layer < stop) THEN held.layer END AS layer, CASE WHEN held IS NOT NULL AND (stop IS NULL OR held.layer < stop) THEN held.value END AS value FROM a""")
def first_layer(t):
    """Configuration layers, of which one may stop the search."""
    layers = t("supplier").select((F.col("s_suppkey") % 5).alias("layer"), F.col("s_nationkey").alias("key"), F.col("s_name").alias("value"), (F.col("s_suppkey") % 6 == 0).alias("stops"))
    return resolve.first_layer(t("customer").select(F.col("c_custkey").alias("lookup_id"), F.col("c_nationkey").alias("key")), layers)


@query("""WITH f AS (SELECT 'src/n' || c_nationkey || '/c' || c_custkey || '/a.cs' AS path FROM customer), p AS (SELECT 'src/n' || n_nationkey AS directory FROM nation WHERE n_nationkey % 2 = 0 UNION SELECT 'src' UNION SELECT 'src/n3/c' || c_custkey FROM customer WHERE c_custkey % 5 = 0)
SELECT path, (SELECT p.directory FROM p WHERE starts_with(f.path, p.directory || '/') ORDER BY length(p.directory) DESC LIMIT 1) AS directory FROM f""")
def nearest_project(t):
    """The project file above a source file."""
    c = t("customer")
    files = c.select(F.concat(F.lit("src/n"), "c_nationkey", F.lit("/c"), "c_custkey", F.lit("/a.cs")).alias("path"))
    projects = t("nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("src/n"), "n_nationkey").alias("directory")).union(c.filter("c_custkey % 5 = 0").select(F.concat(F.lit("src/n3/c"), "c_custkey"))).union(c.sparkSession.createDataFrame([("src",)], "directory string"))
    return resolve.nearest_prefix(files, projects)


@query("""WITH p AS (SELECT DISTINCT 'f' || (o_custkey % 50) AS file, o_orderkey % 3000 AS pos FROM orders), s AS (SELECT 'f' || (p_partkey % 50) AS file, (p_partkey * 37) % 2900 AS a, (p_partkey * 37) % 2900 + p_size * 20 AS b, p_partkey AS node FROM part),
 h AS (SELECT p.file, p.pos, min(struct_pack(n := b - a, node := node)) AS best FROM p JOIN s ON p.file = s.file AND a <= pos AND pos < b GROUP BY 1, 2)
SELECT p.file, p.pos AS "at", best.node AS node FROM p LEFT JOIN h ON p.file = h.file AND p.pos = h.pos""")
def innermost_span(t):
    """The shortest method span around an offset."""
    points = t("orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 50).alias("file"), (F.col("o_orderkey") % 3000).alias("at")).distinct()
    start = F.col("p_partkey") * 37 % 2900
    return resolve.innermost_span(points, t("part").select(F.concat(F.lit("f"), F.col("p_partkey") % 50).alias("file"), start.alias("start"), (start + F.col("p_size") * 20).alias("end"), F.col("p_partkey").alias("node")))


@query("""WITH l AS (SELECT 'f' || (o_custkey % 40) AS file, o_orderkey % 900 AS line FROM orders), m AS (SELECT 'f' || (p_partkey % 40) AS file, p_partkey % 800 AS start_line, p_name AS method FROM part)
SELECT file, line, (SELECT max(struct_pack(s := m.start_line, m := m.method)).m FROM m WHERE m.file = l.file AND m.start_line <= l.line) AS method FROM l""")
def method_of_line(t):
    """The method that a line belongs to."""
    lines = t("orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 40).alias("file"), (F.col("o_orderkey") % 900).alias("line"))
    return resolve.method_of_line(lines, t("part").select(F.concat(F.lit("f"), F.col("p_partkey") % 40).alias("file"), (F.col("p_partkey") % 800).alias("start_line"), F.col("p_name").alias("method")))


@query("""WITH l AS (SELECT c_custkey AS id, c_nationkey AS key FROM customer), r AS (SELECT s_nationkey AS key, s_suppkey % 3 AS tier, s_name AS target FROM supplier),
 f AS (SELECT id, key, min(tier) AS t FROM l LEFT JOIN r USING (key) GROUP BY 1, 2)
SELECT id, CASE WHEN count(DISTINCT r.target) = 1 THEN min(r.target) END AS target, count(DISTINCT r.target) AS n FROM f LEFT JOIN r ON r.key = f.key AND r.tier = f.t GROUP BY id""")
def shared_component(t):
    """A partial view at the first tier that has it, if it is alone there."""
    return resolve.tiered_match(t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key")), t("supplier").select(F.col("s_nationkey").alias("key"), (F.col("s_suppkey") % 3).alias("tier"), F.col("s_name").alias("target")), "key")


@query("""WITH ctl AS (SELECT word AS name, module_no FROM module), u AS (SELECT name, min(module_no) AS module_no FROM ctl GROUP BY name HAVING count(DISTINCT module_no) = 1)
SELECT i.invocation_no, u.module_no AS controller FROM invocation i JOIN module m ON m.module_no = i.module_no LEFT JOIN u ON u.name = m.word""", "module", "invocation")
def view_controller(t):
    """The controller of a view, if its name is declared once."""
    m = t("module")
    views = t("invocation").join(m.select("module_no", F.col("word").alias("name")), "module_no").select("invocation_no", "name")
    return resolve.unique_match(views, m.select(F.col("word").alias("name"), F.col("module_no").alias("controller")), ["name"], "controller").drop("name")


@query("""WITH w AS (SELECT c_custkey AS want_id, m.word AS key, CASE WHEN c_custkey % 3 = 0 THEN 'hr' WHEN c_custkey % 3 = 1 THEN 'zz' ELSE '' END AS schema FROM customer JOIN module m ON m.module_no = c_custkey),
 ix AS (SELECT DISTINCT database_name AS database, word AS key, schema_name AS schema FROM module WHERE database_name <> 'db3'),
 j AS (SELECT want_id, database, w.schema = '' OR ix.schema = w.schema AS exact FROM w JOIN ix USING (key)), s AS (SELECT *, max(exact) OVER (PARTITION BY want_id) AS any_exact FROM j)
SELECT DISTINCT want_id, database, 'matched' AS state FROM s WHERE exact OR NOT any_exact
UNION ALL SELECT DISTINCT CAST(NULL AS BIGINT), database_name, 'unindexed' FROM module WHERE database_name NOT IN (SELECT database FROM ix)""", "module")
def locate_object(t):
    """Databases that hold an object, and those that nobody indexed."""
    m = t("module")
    c = t("customer").join(m, F.col("c_custkey") == F.col("module_no"))
    wanted = c.select(F.col("c_custkey").alias("want_id"), F.col("word").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "hr").when(F.col("c_custkey") % 3 == 1, "zz").otherwise("").alias("schema"))
    index = m.filter("database_name <> 'db3'").select(F.col("database_name").alias("database"), F.col("word").alias("key"), F.col("schema_name").alias("schema"))
    return resolve.locate(wanted, index, m.select(F.col("database_name").alias("database")))


@query("""SELECT module_no % 100 AS k, CASE min(CASE word[1] WHEN 'r' THEN 0 WHEN 'b' THEN 1 WHEN 's' THEN 2 ELSE 4 END) WHEN 0 THEN 'written' WHEN 1 THEN 'module_schema' WHEN 2 THEN 'default_schema' ELSE 'unresolved' END AS schema_source FROM module GROUP BY 1""", "module")
def strongest_source(t):
    """The strongest schema source of a key."""
    c = F.substring("word", 1, 1)
    rows = t("module").select((F.col("module_no") % 100).alias("k"), F.when(c == "r", "written").when(c == "b", "module_schema").when(c == "s", "default_schema").otherwise("unresolved").alias("schema_source"))
    return resolve.strongest_source(rows, ["k"])


_FACTS = """f AS (SELECT invocation_no AS i, CASE WHEN invocation_no % 17 = 0 THEN 'unknown' ELSE 'text' END AS command_type, invocation_no % 19 <> 0 AS sink_known, invocation_no % 7 <> 0 AS is_literal,
 CASE invocation_no % 3 WHEN 0 THEN 'inline' WHEN 1 THEN 'stored_procedure' ELSE CASE WHEN invocation_no % 5 = 0 THEN 'unknown' ELSE 'stored_procedure' END END AS mode, invocation_no % 2 = 0 AS procedure_like,
 CASE WHEN status = 'F' THEN database_name END AS db, CASE WHEN status = 'P' AND invocation_no % 2 = 0 THEN 'unresolved' WHEN status = 'P' THEN 'ambiguous' ELSE '' END AS cs,
 invocation_no % 4 <> 0 AS in_catalog, CASE WHEN invocation_no % 8 = 1 THEN 'unproven_schema' ELSE '' END AS match_reason, invocation_no % 3 AS nd FROM invocation)"""


@query(f"""WITH {_FACTS}, g AS (SELECT *, CASE WHEN command_type = 'unknown' THEN 'command_type_unresolved' WHEN NOT sink_known THEN 'terminal_sink_unresolved' WHEN NOT is_literal THEN 'dynamic_command_text'
  WHEN mode = 'unknown' AND procedure_like THEN 'procedure_prefix_without_mode' WHEN mode = 'unknown' THEN 'command_type_unresolved' END AS gate FROM f)
SELECT i AS invocation_id, CASE WHEN gate IS NOT NULL THEN 'unresolved' WHEN mode = 'inline' THEN 'proven' WHEN db IS NOT NULL AND in_catalog THEN 'proven' WHEN db IS NOT NULL OR cs <> '' THEN 'unresolved' WHEN nd = 1 THEN 'likely' ELSE 'unresolved' END AS evidence,
 CASE WHEN gate IS NOT NULL THEN gate WHEN mode = 'inline' THEN 'inline_sql' WHEN db IS NOT NULL AND in_catalog THEN match_reason WHEN db IS NOT NULL THEN 'not_in_resolved_catalog' WHEN cs = 'unresolved' THEN 'connection_source_unresolved'
  WHEN cs = 'ambiguous' THEN 'ambiguous_connection_source' WHEN nd = 1 THEN 'unique_across_catalogs' WHEN nd = 0 THEN 'unknown_database_source' ELSE 'ambiguous_cross_database' END AS reason FROM g""", "invocation")
def rate_invocations(t):
    """G21 and section 2.13: evidence and reason of each invocation."""
    i = F.col("invocation_no")
    facts = t("invocation").select(
        i.alias("invocation_id"), F.when(i % 17 == 0, "unknown").otherwise("text").alias("command_type"), (i % 19 != 0).alias("sink_known"), (i % 7 != 0).alias("is_literal"),
        F.when(i % 3 == 0, "inline").when(i % 3 == 1, "stored_procedure").when(i % 5 == 0, "unknown").otherwise("stored_procedure").alias("mode"), (i % 2 == 0).alias("procedure_like"),
        F.when(F.col("status") == "F", F.col("database_name")).alias("database"), F.when((F.col("status") == "P") & (i % 2 == 0), "unresolved").when(F.col("status") == "P", "ambiguous").otherwise("").alias("connection_state"),
        (i % 4 != 0).alias("in_catalog"), F.when(i % 8 == 1, "unproven_schema").otherwise("").alias("match_reason"), (i % 3).alias("n_databases"),
    )
    return evidence.rate(facts)


@query("""WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS interface, l_linenumber AS method FROM lineitem), im AS (SELECT s_suppkey AS interface, 1 + s_nationkey % 7 AS method, s_name AS class_name, s_suppkey % 2 = 0 AS mapped FROM supplier
  UNION ALL SELECT s_suppkey, 1 + s_nationkey % 7, 'x' || s_name, true FROM supplier WHERE s_suppkey % 3 = 0),
 j AS (SELECT call_id, count(class_name) AS n, min(class_name) AS cl, bool_and(mapped) AS mp FROM (SELECT c.call_id, im.class_name, im.mapped FROM c LEFT JOIN im ON c.interface = im.interface AND c.method = im.method) GROUP BY call_id),
 r AS (SELECT call_id, cl, CASE WHEN n = 0 THEN 'no_local_implementer' WHEN n > 1 THEN 'ambiguous_implementation' WHEN NOT mp THEN 'unmapped_implementation' ELSE '' END AS reason FROM j)
SELECT call_id, CASE WHEN reason = '' THEN cl END AS target_class, reason FROM r""")
def bound_call_target(t):
    """The one class that implements a called interface method."""
    calls = t("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call_id"), F.col("l_suppkey").alias("interface"), F.col("l_linenumber").alias("method"))
    s = t("supplier")
    method = (1 + F.col("s_nationkey") % 7).alias("method")
    one = s.select(F.col("s_suppkey").alias("interface"), method, F.col("s_name").alias("class_name"), (F.col("s_suppkey") % 2 == 0).alias("mapped"))
    two = s.filter("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("interface"), method, F.concat(F.lit("x"), "s_name").alias("class_name"), F.lit(True).alias("mapped"))
    return evidence.bound_target(calls, one.union(two))


@query("""SELECT database_name AS class_name, priority AS method_name, bool_or(cust % 50 = 0) AS observed FROM invocation GROUP BY 1, 2""", "invocation")
def observed_calls(t):
    """Wrapper methods whose calls touched a database."""
    return evidence.observed_calls(t("invocation").select(F.col("database_name").alias("class_name"), F.col("priority").alias("method_name"), (F.col("cust") % 50 == 0).alias("touches_database")))


@query("""SELECT invocation_no, CASE WHEN status = 'F' THEN 'resolved' WHEN invocation_no % 3 > 0 THEN 'candidate' ELSE 'unresolved' END AS attribution,
 CASE WHEN invocation_no % 2 = 0 THEN 'inline' WHEN invocation_no % 3 = 0 THEN 'stored_procedure' ELSE 'call_site_requires_explicit_stored_procedure_mode' END AS mode FROM invocation""", "invocation")
def attribution_and_mode(t):
    """Database attribution and command mode."""
    i = F.col("invocation_no")
    mode = evidence.command_mode(F.when(i % 2 == 0, "inline").otherwise("call_site"), F.when(i % 3 == 0, "stored_procedure").otherwise("unknown"), F.lit("unknown"))
    return t("invocation").select("invocation_no", evidence.attribution(F.when(F.col("status") == "F", F.col("database_name")), i % 3).alias("attribution"), mode.alias("mode"))


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS name, p_partkey - 1 AS target FROM part WHERE p_partkey % 10 <> 0), w AS (SELECT name, target AS pos FROM a UNION ALL SELECT w.name, a.target FROM w JOIN a ON a.name = w.pos)
SELECT name, min(pos) AS final FROM w GROUP BY name""")
def flatten_aliases(t):
    """The operation at the end of each delegation chain."""
    return evidence.flatten_aliases(t("part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("name"), (F.col("p_partkey") - 1).alias("target")))
