"""Answers to the questions of the service, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph, paths, rank


def find_by_sp(invocations: DataFrame, procedure: str) -> DataFrame:
    """Callers of a procedure: proven, likely, or a diagnostic."""
    answer = F.when(F.col("evidence").isin("proven", "likely"), F.col("evidence")).otherwise("diagnostic")
    return invocations.filter(F.lower("procedure") == procedure.lower()).withColumn("answer", answer)


def find_by_table(records: DataFrame, table: str, write_only: bool = False) -> DataFrame:
    """The strongest access of each path of a file to a table."""
    found = paths.table_accesses(records, table, write_only).withColumn("via_procedure", F.lit(True)).withColumn("ord", F.col("path_id"))
    return rank.strongest_match(found, ["file", "path_id"])


def flow_forward(anchors: DataFrame, edges: DataFrame, operations: DataFrame) -> DataFrame:
    """``anchors(node)`` -> ``(origin, node, depth, target, operation_type)``: what is reached and what it touches."""
    reached = graph.reach(anchors.select(F.col("node").alias("origin"), "node"), edges)
    ops = operations.select(F.col("module").alias("node"), "target", "operation_type").distinct()
    return reached.join(ops, "node").select("origin", "node", "depth", "target", "operation_type")


def flow_backward(table: str, operations: DataFrame, edges: DataFrame, screens: DataFrame) -> DataFrame:
    """Screens ``(screen, node)`` from which a node is reached that touches ``table``, with the calls between them."""
    touching = operations.filter(F.lower("target") == table.lower()).select(F.col("module").alias("node")).distinct()
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    reached = graph.reach(touching.select(F.col("node").alias("origin"), "node"), back)
    found = reached.join(screens, "node")
    return found.groupBy("screen").agg(F.min("depth").alias("depth"), F.countDistinct("origin").alias("touching"))


def analyze(programs: DataFrame, invocations: DataFrame, records: DataFrame) -> DataFrame:
    """``programs(file)`` -> one row each: invocations by evidence, paths, written tables."""
    i = invocations.join(programs, "file", "left_semi").groupBy("file").agg(F.count("*").alias("invocations"), F.count_if(F.col("evidence") == "proven").alias("proven"))
    r = records.join(programs, "file", "left_semi").groupBy("file").agg(F.count("*").alias("paths"), F.countDistinct(F.when(F.col("operation_type").isin("INSERT", "UPDATE", "DELETE", "MERGE"), F.col("target"))).alias("written_tables"))
    return programs.join(i, "file", "left").join(r, "file", "left").na.fill(0)


def path_evidence(records: DataFrame, path_id: str, snapshots: DataFrame) -> DataFrame:
    """One path with the state of its source file: current, stale or missing. ``snapshots(file, hash, read_hash)``."""
    state = F.when(F.col("read_hash").isNull(), "missing").when(F.col("hash") != F.col("read_hash"), "stale").otherwise("current")
    return records.filter(F.col("path_id") == path_id).join(snapshots, "file", "left").withColumn("source_state", state)
