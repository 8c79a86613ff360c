"""Call expansion, execution paths, table accesses, reachability and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import answers, graph, paths

from .registry import query

_EXPAND = """x AS (SELECT module_no AS entry, module_no AS module, [module_no] AS chain, 'ok' AS status FROM module
 UNION ALL SELECT x.entry, c.target, list_append(x.chain, c.target), CASE WHEN list_contains(x.chain, c.target) THEN 'stored_procedure_call_cycle' WHEN len(x.chain) > 5 THEN 'call_expansion_truncated' ELSE 'ok' END
 FROM x JOIN call c ON c.source = x.module WHERE x.status = 'ok')"""


def _calls(t):
    return t("call").select("source", "target")


def _chains(t):
    return graph.expand_bounded(t("module").select(F.col("module_no").alias("module")), _calls(t))


@query(f"WITH RECURSIVE {_EXPAND} SELECT entry, module, list_aggregate(chain, 'string_agg', '>') AS chain, status FROM x", "module", "call")
def expand_calls(t):
    """Call chains of six modules at most, with cycles and cuts."""
    return _chains(t).select("entry", "module", F.array_join(F.transform("chain", lambda m: m.cast("string")), ">").alias("chain"), "status")


_PATHS = f"""{_EXPAND}, op AS (SELECT DISTINCT module_no, operation_no, operation_type, target, dynamic_sql FROM operation),
 p AS (SELECT x.entry, x.chain, o.operation_no, o.operation_type, o.target, o.dynamic_sql, '' AS why FROM x JOIN op o ON o.module_no = x.module WHERE x.status = 'ok'
  UNION ALL SELECT entry, chain, NULL, NULL, NULL, NULL, status FROM x WHERE status <> 'ok'
  UNION ALL SELECT entry, chain, NULL, NULL, NULL, NULL, 'stored_procedure_has_no_terminal_dml' FROM x WHERE status = 'ok' AND module NOT IN (SELECT module_no FROM op) AND module NOT IN (SELECT source FROM call)),
 iv AS (SELECT invocation_no, module_no, procedure_name, database_name, file, CASE status WHEN 'F' THEN 'proven' WHEN 'O' THEN 'likely' ELSE 'unresolved' END AS evidence FROM invocation),
 r AS (SELECT iv.invocation_no, iv.file, p.*, CASE WHEN why = '' AND NOT coalesce(dynamic_sql, false) THEN evidence ELSE 'unresolved' END AS ev,
  'P-' || substr(sha256(concat_ws(chr(31), iv.database_name, iv.file, '0', '0', 'Main', 'dbo', iv.procedure_name, iv.invocation_no, list_aggregate(chain, 'string_agg', '|'), CASE WHEN why = '' THEN CAST(operation_no AS VARCHAR) ELSE 'unresolved:' || why END, '')), 1, 12) AS path_id FROM iv JOIN p ON p.entry = iv.module_no)"""


def _records(t):
    """Paths of every invocation."""
    ops = t("operation").select(F.col("module_no").alias("module"), "operation_no", "operation_type", "target", "dynamic_sql")
    found = paths.terminal_operations(_chains(t), ops, _calls(t))
    inv = t("invocation").select(
        F.col("invocation_no").alias("invocation_id"), F.col("module_no").alias("module"), "file", F.col("database_name").alias("database"), F.lit(0).alias("start"), F.lit(0).alias("end"),
        F.lit("Main").alias("entry_method"), F.lit("dbo").alias("procedure_schema"), F.col("procedure_name"), F.col("invocation_no").alias("snapshot_hash"),
        F.when(F.col("status") == "F", "proven").when(F.col("status") == "O", "likely").otherwise("unresolved").alias("evidence"),
    )
    return paths.path_records(inv, found)


@query(f"WITH RECURSIVE {_PATHS} SELECT path_id, ev AS path_evidence, why AS unresolved_reason, len(chain) AS depth FROM r", "module", "call", "operation", "invocation")
def execution_paths(t):
    """Path records with ids and evidence."""
    return _records(t).select("path_id", "path_evidence", "unresolved_reason", F.size("chain").cast("long").alias("depth"))


_ACCESS = f"""{_PATHS}, a AS (SELECT path_id, file, coalesce(target = 't_7', false) AS hit, coalesce(dynamic_sql, false) AS dyn, operation_type, ev = 'proven' AS proven, len(chain) > 1 AS ind FROM r),
 b AS (SELECT path_id, file, ind AS is_indirect, proven AND hit AND operation_type IN ('INSERT', 'UPDATE', 'DELETE') AS is_write,
  CASE WHEN NOT proven THEN 'UNRESOLVED' WHEN hit AND operation_type IN ('INSERT', 'UPDATE', 'DELETE') THEN CASE WHEN ind THEN 'WRITE_INDIRECT' ELSE operation_type END WHEN ind THEN 'READ_INDIRECT' ELSE 'READ' END AS access_type FROM a WHERE hit OR dyn)"""


@query(f"WITH RECURSIVE {_ACCESS} SELECT path_id, file, access_type, is_write, is_indirect FROM b", "module", "call", "operation", "invocation")
def find_by_table(t):
    """Who reads or writes table t_7, by which path, and how well that is proven."""
    return paths.table_accesses(_records(t), "T_7").select("path_id", "file", "access_type", "is_write", "is_indirect")


@query(f"WITH RECURSIVE {_ACCESS} SELECT count(*) FILTER (NOT is_write) AS excluded, count(*) FILTER (is_write) AS kept FROM b", "module", "call", "operation", "invocation")
def find_by_table_excluded(t):
    """P10: what a question for writes alone leaves out."""
    return paths.excluded_count(paths.table_accesses(_records(t), "t_7"))


@query("""SELECT invocation_no, file, database_name, CASE status WHEN 'F' THEN 'proven' WHEN 'O' THEN 'likely' ELSE 'diagnostic' END AS answer FROM invocation WHERE procedure_name = 'usp_7'""", "invocation")
def find_by_sp(t):
    """API find_by_sp: callers of a procedure by strength."""
    evidence = F.when(F.col("status") == "F", "proven").when(F.col("status") == "O", "likely").otherwise("unresolved")
    calls = t("invocation").select("invocation_no", "file", "database_name", F.col("procedure_name").alias("procedure"), evidence.alias("evidence"))
    return answers.find_by_sp(calls, "USP_7").select("invocation_no", "file", "database_name", "answer")


_EDGE = "e AS (SELECT DISTINCT source, target FROM method_call)"


def _methods(t):
    return t("method_call").select("source", "target")


def _all(t):
    return t("module").select(F.col("module_no").alias("origin"), F.col("module_no").alias("node"))


@query(f"""WITH RECURSIVE {_EDGE}, r AS (SELECT module_no AS origin, module_no AS node FROM module UNION SELECT r.origin, e.target FROM r JOIN e ON e.source = r.node)
SELECT origin, count(*) AS reached, min(node) AS least, max(node) AS most FROM r GROUP BY origin""", "module", "method_call")
def reach_forward(t):
    """Everything reachable from a module."""
    return graph.reach(_all(t), _methods(t)).groupBy("origin").agg(F.count("*").alias("reached"), F.min("node").alias("least"), F.max("node").alias("most"))


@query(f"""WITH RECURSIVE {_EDGE}, r AS (SELECT module_no AS origin, module_no AS node FROM module UNION SELECT r.origin, e.source FROM r JOIN e ON e.target = r.node)
SELECT origin, node FROM r""", "module", "method_call")
def reach_backward(t):
    """Everything from which a module is reached."""
    return graph.reach(_all(t), _methods(t).select(F.col("target").alias("source"), F.col("source").alias("target"))).select("origin", "node")


@query(f"""WITH RECURSIVE {_EDGE}, p AS (SELECT module_no AS start, [module_no] AS chain FROM module UNION ALL SELECT p.start, list_append(p.chain, e.target) FROM p JOIN e ON e.source = p.chain[-1] WHERE NOT list_contains(p.chain, e.target) AND len(p.chain) < 4)
SELECT start, list_aggregate(chain, 'string_agg', '>') AS chain FROM p WHERE len(chain) > 1""", "module", "method_call")
def call_chains(t):
    """Simple call paths of two to four methods."""
    got = graph.simple_paths(_all(t).select("node"), _methods(t))
    return got.select("start", F.array_join(F.transform("chain", lambda m: m.cast("string")), ">").alias("chain"))


@query(f"""WITH RECURSIVE {_EDGE}, b AS (SELECT module_no AS node, [module_no] AS chain FROM module
  UNION ALL SELECT b.node, list_prepend(e.source, b.chain) FROM b JOIN e ON e.target = b.chain[1]),
 d AS (SELECT node, chain FROM b WHERE chain[1] NOT IN (SELECT target FROM e)), k AS (SELECT *, row_number() OVER (PARTITION BY node, chain[1] ORDER BY len(chain) DESC, chain DESC) AS rn FROM d)
SELECT node, chain[1] AS root, list_aggregate(chain, 'string_agg', '>') AS chain FROM k WHERE rn = 1""", "module", "method_call")
def caller_chains(t):
    """The longest caller chain of each entry method, of any length."""
    got = graph.root_chains(_all(t).select("node"), _methods(t))
    return got.select("node", "root", F.array_join(F.transform("chain", lambda m: m.cast("string")), ">").alias("chain"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT source, target, CASE WHEN source % 2 = target % 2 THEN 0 ELSE 1 END AS cost FROM method_call),
 r AS (SELECT module_no AS origin, module_no AS node, 0 AS depth FROM module UNION SELECT r.origin, e.target, r.depth + e.cost FROM r JOIN e ON e.source = r.node WHERE r.depth + e.cost <= 2)
SELECT origin, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY 1, 2""", "module", "method_call")
def related_programs(t):
    """Programs within two levels, where calls inside a file are free."""
    edges = _methods(t).distinct().withColumn("cost", F.when(F.col("source") % 2 == F.col("target") % 2, 0).otherwise(1))
    return graph.reach_with_free_edges(_all(t), edges, 2)


@query("""WITH RECURSIVE rd AS (SELECT 'nation' || n_nationkey AS container, 'region' || n_regionkey AS target, true AS c FROM nation UNION ALL SELECT 'region' || n_regionkey, 'customer' || c_custkey, false FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT 'nation' || s_nationkey, 'supplier' || s_suppkey, false FROM supplier UNION ALL SELECT 'region' || r_regionkey, 'nation' || r_regionkey, true FROM region),
 r AS (SELECT container AS origin, container AS node FROM rd UNION SELECT r.origin, rd.target FROM r JOIN rd ON rd.container = r.node AND rd.c)
SELECT DISTINCT r.origin AS container, rd.target AS base FROM r JOIN rd ON rd.container = r.node AND NOT rd.c""")
def container_lineage(t):
    """Base tables behind views and functions, which may meet in cycles."""
    n = t("nation")
    s = lambda *c: F.concat(*[F.lit(x) if i % 2 == 0 else F.col(x) for i, x in enumerate(c)])
    rows = n.select(s("nation", "n_nationkey").alias("container"), s("region", "n_regionkey").alias("target"), F.lit(True).alias("is_container"))
    rows = rows.union(n.join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).select(s("region", "n_regionkey"), s("customer", "c_custkey"), F.lit(False)))
    rows = rows.union(t("supplier").select(s("nation", "s_nationkey"), s("supplier", "s_suppkey"), F.lit(False)))
    return graph.container_lineage(rows.union(t("region").select(s("region", "r_regionkey"), s("nation", "r_regionkey"), F.lit(True))))


@query("""WITH RECURSIVE c AS (SELECT p_partkey AS source, CAST(floor(p_partkey / 2) AS BIGINT) AS target FROM part WHERE p_partkey > 0),
 f AS (SELECT module_no AS module, '#t' || module_no % 5 AS temp, CASE WHEN module_no % 10 = 0 THEN '#t' || (module_no + 1) % 5 ELSE 'base' || module_no % 17 END AS base FROM module),
 w AS (SELECT module, temp FROM f WHERE module % 13 = 1),
 s AS (SELECT module, temp, base, [module] AS chain, way FROM f, (VALUES ('up'), ('down'), ('here')) AS v(way)
  UNION SELECT n.module, n.temp, n.base, n.chain, n.way FROM s, LATERAL (
    SELECT c.target AS module, s.temp AS temp, s.base AS base, list_prepend(c.target, s.chain) AS chain, x.way AS way FROM c, (VALUES ('up'), ('here')) AS x(way) WHERE c.source = s.module AND s.way = 'up' AND NOT EXISTS (SELECT 1 FROM w WHERE w.module = c.target AND w.temp = s.temp)
    UNION ALL SELECT c.source, s.temp, s.base, list_prepend(c.source, s.chain), x.way FROM c, (VALUES ('down'), ('here')) AS x(way) WHERE c.target = s.module AND s.way = 'down' AND NOT EXISTS (SELECT 1 FROM w WHERE w.module = s.module AND w.temp = s.temp)
    UNION ALL SELECT f.module, f.temp, s.base, s.chain, s.way FROM f WHERE f.module = s.module AND f.base = s.temp) n),
 b AS (SELECT module, temp, base, chain, row_number() OVER (PARTITION BY module, temp, base ORDER BY len(chain), chain) AS rn FROM s WHERE way = 'here' AND base NOT LIKE '#%')
SELECT module, temp, base, list_aggregate(chain, 'string_agg', '>') AS chain FROM b WHERE rn = 1""", "module")
def temp_table_lineage(t):
    """Base tables behind temporary tables, up or down the calls, with names that are a module's own."""
    m, p = F.col("module_no"), F.col("p_partkey")
    fills = t("module").select(m.alias("module"), F.concat(F.lit("#t"), m % 5).alias("temp"), F.when(m % 10 == 0, F.concat(F.lit("#t"), (m + 1) % 5)).otherwise(F.concat(F.lit("base"), m % 17)).alias("base"))
    calls = t("part").filter(p > 0).select(p.alias("source"), F.floor(p / 2).cast("long").alias("target"))
    got = graph.temp_table_lineage(fills.sparkSession, fills, calls, fills.filter("module % 13 = 1").select("module", "temp"))
    return got.select("module", "temp", "base", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("chain"))
