"""Aggregates, ranking, differences and freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import aggregate, difference, rank

from .registry import query


def _calls(t):
    return t("invocation").select("file", F.col("procedure_name").alias("procedure"), F.col("database_name").alias("database"), "system", "status", "priority", "invocation_no")


@query("""SELECT count(DISTINCT file) AS total_files, count(*) AS sp_calls, count(DISTINCT lower(procedure_name)) AS unique_sps, count(DISTINCT database_name) AS databases, (SELECT count(DISTINCT target) FROM operation) AS unique_tables FROM invocation""", "invocation", "operation")
def scan_statistics(t):
    """A1."""
    return aggregate.scan_statistics(_calls(t).select("file"), _calls(t), t("operation").select(F.col("target").alias("table")))


@query("SELECT *, row_number() OVER (ORDER BY n DESC, procedure) AS position FROM (SELECT procedure_name AS procedure, count(*) AS n FROM invocation GROUP BY 1) ORDER BY n DESC, procedure LIMIT 20", "invocation")
def sp_frequency(t):
    """A2: the 20 procedures called most."""
    return rank.top(aggregate.frequency(_calls(t), "procedure"), 20, F.desc("n"), F.col("procedure")).withColumn("position", F.col("position").cast("long"))


@query("SELECT *, row_number() OVER (ORDER BY n DESC, file) AS position FROM (SELECT file, count(*) AS n FROM invocation GROUP BY 1) ORDER BY n DESC, file LIMIT 15", "invocation")
def file_ranking(t):
    """The 15 files with most calls."""
    return rank.top(aggregate.frequency(_calls(t), "file"), 15, F.desc("n"), F.col("file")).withColumn("position", F.col("position").cast("long"))


@query("SELECT database_name AS database, count(*) AS n FROM invocation GROUP BY 1", "invocation")
def database_distribution(t):
    """A4."""
    return aggregate.frequency(_calls(t), "database")


@query("SELECT database_name AS database, count(DISTINCT procedure_name) AS procedures, count(DISTINCT file) AS files FROM invocation GROUP BY 1", "invocation")
def database_summary(t):
    """A5, S11."""
    return aggregate.database_summary(_calls(t))


@query("""SELECT *, row_number() OVER (ORDER BY impact DESC, procedure) AS position FROM (SELECT procedure_name AS procedure, count(*) AS calls, count(DISTINCT file) AS files, count(*) * 2 + count(DISTINCT file) * 3 AS impact FROM invocation GROUP BY 1) ORDER BY impact DESC, procedure LIMIT 15""", "invocation")
def high_impact(t):
    """The 15 procedures of highest impact."""
    return rank.top(aggregate.impact(_calls(t)), 15, F.desc("impact"), F.col("procedure")).withColumn("position", F.col("position").cast("long"))


@query("SELECT file, procedure_name AS procedure, count(*) AS weight FROM invocation GROUP BY 1, 2", "invocation")
def call_weights(t):
    """A7."""
    return aggregate.edge_weights(_calls(t), "file", "procedure")


@query("""SELECT target AS "table", string_agg(DISTINCT operation_type, ',' ORDER BY operation_type) AS access_types, count(DISTINCT module_no) AS files FROM operation GROUP BY 1""", "operation")
def table_usage(t):
    """How each table is used and by how many files."""
    return aggregate.table_usage(t("operation").select(F.col("target").alias("table"), F.col("operation_type").alias("access_type"), F.col("module_no").alias("file")))


@query("""SELECT system, database_name AS root, count(*) AS total, count(*) FILTER (status = 'F') AS resolved_count, round(count(*) FILTER (status = 'F') / count(*), 4) AS share FROM invocation GROUP BY GROUPING SETS ((system), (system, database_name))""", "invocation")
def coverage(t):
    """A10: shares of each scan root and system."""
    return aggregate.coverage(_calls(t).select("system", F.col("database").alias("root"), (F.col("status") == "F").alias("resolved"), F.col("priority").alias("reason")))


@query("""SELECT system, priority AS reason, count(*) AS n, row_number() OVER (PARTITION BY system ORDER BY count(*) DESC, priority) AS place FROM invocation WHERE status <> 'F' GROUP BY 1, 2""", "invocation")
def coverage_reasons(t):
    """Reasons by count and code."""
    return aggregate.reasons(_calls(t).select("system", (F.col("status") == "F").alias("resolved"), F.col("priority").alias("reason"))).withColumn("place", F.col("place").cast("long"))


@query("""SELECT system, count(*) AS total, count(*) FILTER (status = 'F') AS proven, count(*) FILTER (status = 'X') AS likely, count(*) FILTER (status NOT IN ('F', 'X')) AS unresolved FROM invocation GROUP BY 1""", "invocation")
def cutover_summary(t):
    """Statuses with their zeros."""
    return aggregate.evidence_summary(_calls(t).select("system", F.when(F.col("status") == "F", "proven").when(F.col("status") == "X", "likely").otherwise("unresolved").alias("evidence")), "system")


@query("""WITH g AS (SELECT database_name AS class_name, procedure_name AS method_name, count(*) FILTER (status <> 'F') AS unresolved, coalesce(string_agg(DISTINCT system, ',' ORDER BY system) FILTER (status <> 'F'), '') AS systems, bool_or(status = 'F') AS resolved_elsewhere FROM invocation GROUP BY 1, 2)
SELECT *, CASE WHEN resolved_elsewhere THEN 'call_site' ELSE 'method' END AS tier FROM g WHERE unresolved > 0""", "invocation")
def exclusion_candidates(t):
    """A12."""
    return aggregate.exclusion_candidates(_calls(t).select("system", F.col("database").alias("class_name"), F.col("procedure").alias("method_name"), (F.col("status") == "F").alias("resolved")))


@query("SELECT module_no, count(DISTINCT target) * 2 + count(*) FILTER (operation_type = 'UPDATE') * 3 + CAST(bool_or(operation_type = 'DELETE') AS INTEGER) + count(*) FILTER (operation_type = 'INSERT') * 5 AS score FROM operation GROUP BY 1", "operation")
def procedure_scores(t):
    """A14."""
    o = F.col("operation_type")
    agg = t("operation").groupBy("module_no").agg(F.countDistinct("target").alias("a"), F.count_if(o == "UPDATE").alias("b"), F.bool_or(o == "DELETE").alias("c"), F.count_if(o == "INSERT").alias("d"))
    return agg.select("module_no", aggregate.procedure_score(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("score"))


@query("""SELECT count(*) FILTER (l_suppkey % 5 = 0) AS empty_schema, count(*) FILTER (l_linenumber = 1) AS cte_reads, count(*) FILTER (l_linenumber = 2) AS alias_writes, count(DISTINCT CASE WHEN l_suppkey % 5 = 0 THEN l_suppkey END) AS unproven_targets FROM lineitem""")
def rebuild_report(t):
    """A15."""
    s = F.when(F.col("l_suppkey") % 5 == 0, "unresolved").otherwise("written")
    return aggregate.rebuild_report(t("lineitem").select(s.alias("schema_source"), F.col("l_suppkey").alias("target"), (F.col("l_linenumber") == 1).alias("is_cte"), (F.col("l_linenumber") == 2).alias("is_alias_write")))


@query("SELECT o_custkey % 20 AS system, min(o_orderdate) AS oldest, bool_and(o_orderkey % 97 <> 0) AS usable FROM orders GROUP BY 1")
def oldest_saved(t):
    """A19."""
    return aggregate.oldest_saved(t("orders").select((F.col("o_custkey") % 20).alias("system"), F.col("o_orderdate").alias("saved_at"), (F.col("o_orderkey") % 97 != 0).alias("usable")))


@query("""SELECT system, CAST(sum(cust) AS BIGINT) AS files, CAST(sum(invocation_no) AS BIGINT) AS calls, max_by(file, invocation_no) AS source FROM invocation GROUP BY 1""", "invocation")
def merge_scans(t):
    """A18."""
    return aggregate.merge_scans(t("invocation").select("system", F.col("invocation_no").alias("ord"), F.col("cust").alias("files"), F.col("invocation_no").alias("calls"), F.col("file").alias("source")))


@query("""SELECT concat('db', user_id % 5) AS database, CASE event_type WHEN 'view' THEN 'views' WHEN 'click' THEN 'procedures' WHEN 'purchase' THEN 'procedures' WHEN 'signup' THEN 'tables' END AS kind, count(*) AS n, max(ts) AS latest FROM events WHERE event_type <> 'error' GROUP BY 1, 2""")
def catalog_fingerprint(t):
    """Count and latest change of each kind group."""
    objects = t("events").select(F.concat(F.lit("db"), F.col("user_id") % 5).alias("database"), F.col("event_type").alias("type"), F.col("ts").alias("modified"))
    return aggregate.fingerprint(objects, {"view": "views", "click": "procedures", "purchase": "procedures", "signup": "tables"})


@query("""SELECT user_id AS cache, CASE max_by(event_type, struct_pack(a := ts, b := event_id)) WHEN 'purchase' THEN 'refreshing' WHEN 'error' THEN 'outdated' WHEN 'signup' THEN 'behind_source' ELSE 'current' END AS state FROM events GROUP BY 1""")
def cache_freshness(t):
    """Freshness of each cache by its latest event."""
    e = rank.latest(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id")
    return aggregate.freshness(e.select(F.col("user_id").alias("cache"), (F.col("event_type") == "purchase").alias("refreshing"), (F.col("event_type") != "error").alias("format_ok"), (F.col("event_type") == "signup").alias("behind")))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def latest_job(t):
    """The latest job of each key."""
    return rank.latest(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("""WITH a AS (SELECT user_id, event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM a WHERE g <= 100 OR k = 1""")
def pruned_jobs(t):
    """The 100 latest jobs and each key's latest."""
    return rank.prune(t("events").select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", 100).select("user_id", "event_id")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM events WHERE event_type = 'view'")
def queue_position(t):
    """W10."""
    rows = rank.queue_position(t("events").filter("event_type = 'view'"), "user_id", "ts", "event_id")
    return rows.select("event_id", "user_id", F.col("position").cast("long").alias("position"))


_MATCHES = """m AS (SELECT module_no, target AS file, operation_type AS access_type, operation_no % 3 = 0 AS is_indirect, operation_no % 2 = 0 AS via_procedure, operation_no AS ord FROM operation)"""
_RANK = "CASE WHEN access_type IN ('INSERT', 'UPDATE', 'DELETE') THEN 2 WHEN access_type = 'READ' THEN 1 ELSE 0 END"


def _matches(t):
    n = F.col("operation_no")
    return t("operation").select("module_no", F.col("target").alias("file"), F.col("operation_type").alias("access_type"), (n % 3 == 0).alias("is_indirect"), (n % 2 == 0).alias("via_procedure"), n.alias("ord"))


@query(f"""WITH {_MATCHES}, r AS (SELECT *, row_number() OVER (PARTITION BY module_no, file ORDER BY {_RANK} DESC, is_indirect, via_procedure DESC, ord) AS rn FROM m) SELECT module_no, file, any_value(access_type) AS access_type, any_value(is_indirect) AS is_indirect FROM r WHERE rn = 1 GROUP BY 1, 2""", "operation")
def strongest_match(t):
    """The strongest table match of each identity."""
    return rank.strongest_match(_matches(t).distinct(), ["module_no", "file"]).select("module_no", "file", "access_type", "is_indirect")


@query(f"""WITH {_MATCHES}, g AS (SELECT file, max({_RANK}) AS r FROM m WHERE ord % 7 = 0 GROUP BY 1) SELECT file, ord FROM m LEFT JOIN g USING (file) WHERE ord % 7 = 3 AND coalesce(g.r, -1) <= {_RANK}""", "operation")
def inline_not_outranked(t):
    """Inline matches that no graph match of their file outranks."""
    return rank.without_outranked(_matches(t).filter("ord % 7 = 3"), _matches(t).filter("ord % 7 = 0")).select("file", "ord")


@query("""WITH p AS (SELECT o_orderkey AS id, o_custkey % 100 AS var, o_orderkey % 5000 AS pos FROM orders), a AS (SELECT p_partkey % 100 AS var, (p_partkey * 11) % 5000 AS pos, p_name AS value FROM part)
SELECT var, pos AS "at", (SELECT max(struct_pack(s := a.pos, v := a.value)).v FROM a WHERE a.var = p.var AND a.pos < p.pos) AS value FROM p""")
def nearest_assignment(t):
    """The last assignment of a variable before a position."""
    points = t("orders").select((F.col("o_custkey") % 100).alias("var"), (F.col("o_orderkey") % 5000).alias("at"))
    return rank.before(points, t("part").select((F.col("p_partkey") % 100).alias("var"), (F.col("p_partkey") * 11 % 5000).alias("at"), F.col("p_name").alias("value")), "var", "at", "value")


@query("""WITH p AS (SELECT 'P' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS path_id, o_orderkey % 3 AS n_writes, o_orderkey % 5 AS keyword_hits, o_custkey % 4 AS entry_hits FROM orders)
SELECT path_id, row_number() OVER (ORDER BY (n_writes = 0), keyword_hits DESC, entry_hits DESC, path_id) AS position, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p) - 20 AS omitted FROM p ORDER BY position LIMIT 20""")
def compact_paths(t):
    """The compact answer of 20 paths."""
    p = t("orders").select(F.concat(F.lit("P"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("path_id"), (F.col("o_orderkey") % 3).alias("n_writes"), (F.col("o_orderkey") % 5).alias("keyword_hits"), (F.col("o_custkey") % 4).alias("entry_hits"))
    return rank.compact(p).select("path_id", F.col("position").cast("long").alias("position"), "total", "omitted")


@query("""WITH l AS (SELECT module_no % 300 AS m, operation_type AS op, operation_no FROM operation WHERE operation_no % 3 <> 0), r AS (SELECT module_no % 300 AS m, operation_type AS op, operation_no FROM operation WHERE operation_no % 3 <> 1),
 a AS (SELECT m, op, row_number() OVER (PARTITION BY m, op ORDER BY operation_no) AS rank FROM l), b AS (SELECT m, op, row_number() OVER (PARTITION BY m, op ORDER BY operation_no) AS rank FROM r)
SELECT coalesce(a.m, b.m) AS m, coalesce(a.op, b.op) AS op, coalesce(a.rank, b.rank) AS rank, CASE WHEN a.m IS NULL THEN 'right_only' WHEN b.m IS NULL THEN 'left_only' ELSE 'both' END AS pair FROM a FULL JOIN b ON a.m = b.m AND a.op = b.op AND a.rank = b.rank""", "operation")
def migration_diff(t):
    """Two scans paired by identity and rank."""
    o = t("operation").select((F.col("module_no") % 300).alias("m"), F.col("operation_type").alias("op"), "operation_no")
    return difference.multiset_diff(o.filter("operation_no % 3 <> 0"), o.filter("operation_no % 3 <> 1"), ["m", "op"], "operation_no").withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT coalesce(a.p_partkey, b.p_partkey) AS op, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'added' WHEN a.v <> b.v THEN 'behavior_changed' ELSE 'same' END AS state
FROM (SELECT p_partkey, p_size % 3 AS v FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey, p_size % 4 AS v FROM part WHERE p_partkey % 7 <> 0) b USING (p_partkey)""")
def contract_surface_diff(t):
    """Operations that two contract versions have."""
    p = t("part")
    v = lambda k, m: p.filter(f"p_partkey % {k} <> 0").select(F.col("p_partkey").alias("op"), (F.col("p_size") % m).alias("v"))
    return difference.surface_diff(v(5, 3), v(7, 4), "op", "v")


@query("""WITH o AS (SELECT DISTINCT source AS module, source, target, 'calls' AS type FROM call WHERE source % 5 <> 0 AND source % 10 <> 7), n AS (SELECT DISTINCT source AS module, source, target, 'calls' AS type FROM call WHERE source % 7 <> 0 AND source % 10 <> 7)
SELECT *, 'old' AS side FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'new' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""", "call")
def graph_diff(t):
    """Edges on one side only, without changed modules."""
    e = t("call").select(F.col("source").alias("module"), "source", "target", F.lit("calls").alias("type"))
    return difference.graph_diff(e.filter("source % 5 <> 0"), e.filter("source % 7 <> 0"), e.filter("source % 10 = 7"))


@query("""SELECT invocation_no, file, CASE WHEN cust % 9 = 0 THEN 'new' ELSE 'old' END AS version FROM invocation""", "invocation")
def incremental_refresh(t):
    """Rows of affected files are replaced."""
    i = t("invocation").select("invocation_no", "file", "cust")
    affected = i.filter("cust % 9 = 0").select("file")
    return difference.refresh(i.withColumn("version", F.lit("old")), i.withColumn("version", F.lit("new")), affected, "file").select("invocation_no", "file", "version")


@query("SELECT DISTINCT file FROM invocation WHERE cust % 6 = 1 EXCEPT SELECT file FROM invocation WHERE cust % 4 = 1", "invocation")
def removed_files(t):
    """Files that are no longer there."""
    i = t("invocation")
    return difference.removed(i.filter("cust % 6 = 1"), i.filter("cust % 4 = 1"), "file")


@query("SELECT DISTINCT system AS scope FROM invocation WHERE database_name IN ('db1', 'db3')", "invocation")
def affected_scopes(t):
    """Scopes to derive again after a cache was refreshed."""
    i = t("invocation")
    return difference.affected_scopes(i.select(F.col("system").alias("scope"), F.col("database_name").alias("cache")), i.filter("database_name in ('db1', 'db3')").select(F.col("database_name").alias("cache")))


@query("""SELECT w.s AS system, r.root, CASE WHEN r.root IS NULL THEN 'unknown_system' WHEN NOT r.ok THEN 'root_not_found' ELSE '' END AS reason FROM (SELECT n_nationkey AS s FROM nation) w LEFT JOIN (SELECT s_nationkey AS s, s_name AS root, s_suppkey % 4 <> 0 AS ok FROM supplier WHERE s_nationkey % 3 <> 0) r USING (s)""")
def expand_targets(t):
    """(system, root) rows with the reason why one is missing."""
    roots = t("supplier").filter("s_nationkey % 3 <> 0").select(F.col("s_nationkey").alias("system"), F.col("s_name").alias("root"), (F.col("s_suppkey") % 4 != 0).alias("exists"))
    return difference.expand_targets(t("nation").select(F.col("n_nationkey").alias("system")), roots)
