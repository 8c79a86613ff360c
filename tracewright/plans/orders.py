"""Queries of orders, limits, unions and the rules of contracts and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import access, aggregate, graph, rank, resolve

from .lineage import _all, _methods
from .registry import query


@query("""SELECT l_suppkey AS file, min_by(l_orderkey * 10 + l_linenumber, struct_pack(a := l_returnflag = 'R', b := CASE WHEN l_linestatus = 'O' THEN -2 ELSE -1 END, c := l_linenumber > 3, d := l_orderkey * 10 + l_linenumber)) AS ord FROM lineitem GROUP BY 1""")
def inline_match(t):
    """One inline match of each file, a direct read first."""
    rows = t("lineitem").select(
        F.col("l_suppkey").alias("file"), (F.col("l_returnflag") == "R").alias("read_through"), F.when(F.col("l_linestatus") == "O", "UPDATE").otherwise("READ").alias("access_type"),
        (F.col("l_linenumber") > 3).alias("is_indirect"), F.lit(False).alias("via_procedure"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )
    return rank.inline_match(rows).select("file", "ord")


@query("""SELECT invocation_no, row_number() OVER (ORDER BY file, module_no, invocation_no) - 1 AS position FROM invocation""", "invocation")
def path_order(t):
    """The place of each path by file, span, entry, chain, operation, reason and id."""
    none = F.lit("")
    rows = t("invocation").select(
        "invocation_no", "file", F.col("module_no").alias("start"), F.col("module_no").alias("end"), none.alias("entry_method"), F.array("invocation_no").alias("chain"),
        F.lit(0).alias("operation_no"), none.alias("unresolved_reason"), none.alias("path_id"),
    )
    return rank.ranged(rows, rank.path_order()).select("invocation_no", "position")


@query("""SELECT invocation_no, row_number() OVER (ORDER BY file, lpad(CAST(invocation_no AS VARCHAR), 12, '0')) - 1 AS position FROM invocation""", "invocation")
def access_order(t):
    """The place of each access by entry, path and type."""
    rows = t("invocation").select("invocation_no", F.col("file").alias("entry_method"), F.lpad(F.col("invocation_no").cast("string"), 12, "0").alias("path_id"), F.lit("READ").alias("access_type"))
    return rank.ranged(rows, rank.access_order()).select("invocation_no", "position")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT target AS source, source AS target FROM method_call), r AS (SELECT module_no AS origin, module_no AS node, 0 AS depth FROM module UNION SELECT r.origin, e.target, r.depth + 1 FROM r JOIN e ON e.source = r.node WHERE r.depth < 3),
 m AS (SELECT origin, node, min(depth) AS depth FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY depth, node) AS place FROM m WHERE depth > 0) SELECT origin, node, CAST(place AS INTEGER) AS place FROM k WHERE place <= 10""", "module", "method_call")
def related_programs_listed(t):
    """The ten related programs found first, those nearer first."""
    back = _methods(t).select(F.col("target").alias("source"), F.col("source").alias("target")).distinct().withColumn("cost", F.lit(1))
    found = graph.reach_with_free_edges(_all(t), back, 3).filter("depth > 0")
    return rank.first_of_each(found, "origin", 10, F.col("depth"), F.col("node")).select("origin", "node", "place")


@query("""SELECT database_name AS database, schema_name AS schema, word AS key FROM module UNION SELECT 'db' || p_size % 4, 'dbo', p_name FROM part""", "module")
def merged_catalog(t):
    """Catalogs of several databases as one."""
    one = t("module").select(F.col("database_name").alias("database"), F.col("schema_name").alias("schema"), F.col("word").alias("key"))
    two = t("part").select(F.concat(F.lit("db"), F.col("p_size") % 4).alias("database"), F.lit("dbo").alias("schema"), F.col("p_name").alias("key"))
    return resolve.merged_catalog(one, two, one)


@query("""SELECT 'db' || p_size % 4 AS database, count(*) FILTER (p_partkey % 7 < 3) AS procedures, count(*) FILTER (p_partkey % 7 IN (3, 4)) AS views, count(*) FILTER (p_partkey % 7 = 5) AS functions, count(*) FILTER (p_partkey % 7 = 6) AS tables FROM part GROUP BY 1""")
def kind_counts(t):
    """How many objects of each kind a database has."""
    k = F.col("p_partkey") % 7
    kind = F.when(k < 3, "procedures").when(k < 5, "views").when(k == 5, "functions").otherwise("tables")
    return aggregate.kind_counts(t("part").select(F.concat(F.lit("db"), F.col("p_size") % 4).alias("database"), kind.alias("kind")))


@query("""SELECT procedure_name AS procedure, count(*) AS calls, string_agg(DISTINCT file, ',' ORDER BY file) AS callers FROM invocation GROUP BY 1""", "invocation")
def procedure_list(t):
    """Procedures with their callers."""
    return aggregate.procedure_list(t("invocation").select(F.col("procedure_name").alias("procedure"), "file"))


@query("""WITH s AS (SELECT 'n' || s_nationkey AS key, min(s_name) AS database FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1), r AS (SELECT c_custkey AS lookup_id, 'n' || c_nationkey AS key, c_custkey % 4 <> 0 AS has_table FROM customer)
SELECT lookup_id, CASE WHEN has_table THEN database ELSE key END AS database, CASE WHEN has_table AND database IS NULL THEN 'connection_key_not_found' ELSE '' END AS reason FROM r LEFT JOIN s USING (key)""")
def database_of_key(t):
    """D3: a key stands for the database where a file has no lookup table."""
    table = t("supplier").filter("s_nationkey % 3 <> 0").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("key")).agg(F.min("s_name").alias("database"))
    return access.database_of_key(t("customer").select(F.col("c_custkey").alias("lookup_id"), F.concat(F.lit("n"), "c_nationkey").alias("key"), (F.col("c_custkey") % 4 != 0).alias("has_table")), table)


@query("""WITH a AS (SELECT s_nationkey AS contract, 'f' || s_suppkey % 6 AS fingerprint, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS revision FROM supplier), c AS (SELECT DISTINCT c_custkey % 30 AS contract, 'f' || c_custkey % 8 AS fingerprint FROM customer),
 j AS (SELECT c.contract, c.fingerprint, min(a.revision) FILTER (a.fingerprint = c.fingerprint) AS held, max(a.revision) AS last FROM c LEFT JOIN a ON a.contract = c.contract GROUP BY 1, 2)
SELECT contract, CAST(coalesce(held, last + 1, 1) AS BIGINT) AS revision, CASE WHEN held IS NOT NULL THEN 'reused' WHEN last IS NOT NULL THEN 'new_revision' ELSE 'new_contract' END AS state FROM j""")
def contract_revisions(t):
    """The revision of a contract by its fingerprint."""
    from pyspark.sql import Window as W

    accepted = t("supplier").select(F.col("s_nationkey").cast("long").alias("contract"), F.concat(F.lit("f"), F.col("s_suppkey") % 6).alias("fingerprint"), F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long").alias("revision"))
    contracts = t("customer").select((F.col("c_custkey") % 30).cast("long").alias("contract"), F.concat(F.lit("f"), F.col("c_custkey") % 8).alias("fingerprint")).distinct()
    return access.contract_revisions(contracts, accepted)
