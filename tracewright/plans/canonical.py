"""Fact tables made of the star schema, by SQL that Spark and the oracle both run.

The star schema holds no source code, so each table is a fixed projection of it; what is tested is the operator.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: name -> (tables or earlier projections it reads, SQL with them in braces)
FACTS: dict[str, str] = {
    "module": """SELECT p_partkey AS module_no, concat('usp_', p_partkey) AS name,
        CASE WHEN p_size % 3 = 0 THEN 'dbo' WHEN p_size % 3 = 1 THEN 'hr' ELSE '' END AS schema_name,
        concat('db', p_size % 4) AS database_name, p_brand AS brand, p_name AS word FROM {part}""",
    "call": """SELECT p_partkey AS source, (p_partkey * 7 + 3) % n AS target FROM {part}, (SELECT count(*) AS n FROM {part}) c WHERE p_partkey % 3 <> 0
        UNION ALL SELECT p_partkey AS source, (p_partkey * 5 + 1) % n AS target FROM {part}, (SELECT count(*) AS n FROM {part}) c WHERE p_partkey % 8 = 0""",
    "method_call": """SELECT p_partkey AS source, CAST(floor(p_partkey / 2) AS BIGINT) AS target FROM {part} WHERE p_partkey > 0
        UNION ALL SELECT p_partkey AS source, CAST(floor(p_partkey / 3) AS BIGINT) AS target FROM {part} WHERE p_partkey > 0 AND p_partkey % 7 = 0""",
    "operation": """SELECT l_partkey AS module_no, l_orderkey * 10 + l_linenumber AS operation_no,
        CASE WHEN l_returnflag = 'R' THEN 'DELETE' WHEN l_returnflag = 'A' THEN 'UPDATE' WHEN l_linestatus = 'O' THEN 'INSERT' ELSE 'SELECT' END AS operation_type,
        concat('t_', l_suppkey) AS target, l_suppkey % 5 = 0 AS dynamic_sql FROM {lineitem}""",
    "invocation": """SELECT o_orderkey AS invocation_no, concat('f', o_custkey, '.cs') AS file, o_orderkey % n AS module_no,
        concat('usp_', o_orderkey % n) AS procedure_name, concat('db', o_custkey % 4) AS database_name, o_orderstatus AS status,
        o_orderpriority AS priority, concat('sys', o_custkey % 7) AS system, o_custkey AS cust
        FROM {orders}, (SELECT count(*) AS n FROM {part}) c""",
    "job": "SELECT event_id, user_id, event_type, ts, value FROM {events}",
}


def fact(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection or, if there is none of the name, a table."""
    if name not in FACTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = set(re.findall(r"\{(\w+)\}", FACTS[name]))
    return spark.sql(FACTS[name], **{t: fact(spark, sf_dir, t) for t in used})


def oracle(sql: str, *facts: str) -> str:
    """``sql`` with the projections it reads as common table expressions; keeps WITH RECURSIVE in front."""
    ctes = [f"{f} AS ({re.sub(r'[{}]', '', FACTS[f])})" for f in facts]
    recursive = sql.lstrip().upper().startswith("WITH RECURSIVE")
    body = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql, count=1) if re.match(r"\s*WITH ", sql) else None
    head = "WITH RECURSIVE " if recursive else "WITH "
    if body is not None:
        return head + ", ".join([*ctes, body])
    return (head + ", ".join(ctes) + " " + sql) if ctes else sql
