"""The execution graph of one database: listed objects and their parsed statements as nodes and relationships."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewright.functions import tsql
from tracewright.names import fold_key, recorded_source

from . import resolve
from .graph import cut, temp_table_lineage

MODULES = ("stored_procedure", "view", "function")


@dataclass
class Graph:
    """``nodes(node_id, type, schema, name, scope, module_id, operation_type, sequence, conditions)``,
    ``edges(type, source, target, schema_source, database, server, branch_path, conditions, columns, confidence, lineage)``
    and ``errors(module_id, message)`` of modules that could not be parsed."""

    nodes: DataFrame
    edges: DataFrame
    errors: DataFrame


def node_id(kind: Column, schema: Column, name: Column, scope: Column | None = None) -> Column:
    """Identity of a node: type, schema and name whatever their case; a ``#`` table belongs to its module."""
    plain = F.concat(kind, F.lit(":"), fold_key(schema), F.lit("."), fold_key(name))
    return plain if scope is None else F.when(is_scoped(name), F.concat(plain, F.lit("@"), scope)).otherwise(plain)


def is_scoped(name: Column) -> Column:
    """Whether a temporary table is its module's own; one with ``##`` is the database's."""
    return name.startswith("#") & ~name.startswith("##")


def _another_database(stated: Column, own: str) -> Column:
    return (stated != "") & (fold_key(stated) != fold_key(F.lit(own))) if own else stated != ""


def listed_nodes(objects: DataFrame) -> DataFrame:
    """``objects(type, schema, name)`` as nodes; an object without a schema is of ``dbo``. The first by name of a key stays."""
    schema = F.when(F.coalesce("schema", F.lit("")) == "", "dbo").otherwise(F.col("schema"))
    named = objects.filter("coalesce(name, '') <> ''").select("type", schema.alias("schema"), "name")
    best = F.min(F.struct("schema", "name"))
    return named.groupBy(node_id(F.col("type"), F.col("schema"), F.col("name")).alias("node_id"), "type").agg(best.alias("b")).select("node_id", "type", "b.schema", "b.name")


def _references(operations: DataFrame) -> DataFrame:
    """A row for each name that an operation reads, writes, uses or calls, with its place."""
    kinds = (("reads", "read_tables"), ("writes", "write_tables"), ("uses", "function_references"), ("calls", "call_targets"))

    def placed(kind: str, column: str) -> Column:
        return F.transform(column, lambda n, i: F.struct(F.lit(kind).alias("role"), i.alias("place"), n.alias("n")))

    each = F.flatten(F.array(*[placed(k, c) for k, c in kinds]))
    return operations.select("module_id", "module_schema", "sequence", "operation_id", "branch_path", "conditions", "written_columns", F.explode(each).alias("r")).select(
        "module_id", "module_schema", "sequence", "operation_id", "branch_path", "conditions", "written_columns", "r.role", "r.place",
        *[F.coalesce(f"r.n.{c}", F.lit("")).alias(c) for c in ("server", "database", "schema", "name")],
    ).filter("name <> ''")


def resolved(references: DataFrame, listed: DataFrame, own: str) -> DataFrame:
    """``references`` with ``resolved_schema``, ``schema_source`` and ``node``, the listed node that each names, if any.

    A call through a linked server or to another database keeps what it states and names no listed node. A table names
    a listed view before a function, and only with a schema and in the own database; a function reference a function.
    """
    refs = references.withColumn("ref_id", F.struct("module_id", "sequence", "role", "place")).withColumn("key", fold_key(F.col("name")))
    away = (F.col("server") != "") | _another_database(F.col("database"), own)
    refs = cut(refs.withColumn("away", F.when(F.col("role") == "calls", away).otherwise(_another_database(F.col("database"), own))))
    holding = listed.select("schema", fold_key(F.col("name")).alias("key"))
    ask = lambda rows: rows.select("ref_id", F.when(F.col("role") == "calls", "").otherwise(F.col("database")).alias("database"), "schema", "key", "module_schema")
    calls = refs.filter("role = 'calls'")
    found = resolve.resolve_schema(ask(refs.filter("role <> 'calls'")), holding).unionByName(resolve.resolve_schema(ask(calls.filter("not away")), holding, calls=True))
    stated = calls.filter("away").select("ref_id", F.col("schema").alias("resolved_schema"), recorded_source(F.lit(""), F.col("schema")).alias("schema_source"))
    with_schema = refs.join(found.unionByName(stated), "ref_id")
    modules = listed.filter(F.col("type").isin(*MODULES)).select(F.col("type").alias("listed_type"), fold_key(F.col("schema")).alias("listed_schema"), fold_key(F.col("name")).alias("key"), F.col("node_id").alias("node"))
    kind = F.when(F.col("role") == "calls", F.col("listed_type") == "stored_procedure").when(F.col("role") == "uses", F.col("listed_type") == "function").otherwise(F.col("listed_type") != "stored_procedure")
    fits = kind & (F.col("resolved_schema") != "") & (fold_key(F.col("resolved_schema")) == F.col("listed_schema")) & ~F.col("away")
    joined = with_schema.join(modules, "key", "left")
    node = F.min(F.when(fits, F.struct((F.col("listed_type") != "view").alias("after"), "node")))["node"]
    hits = joined.groupBy("ref_id").agg(node.alias("node"))
    return with_schema.join(hits, "ref_id")


def build(objects: DataFrame, database: str = "") -> Graph:
    """``objects(type, schema, name, definition)`` of one database as a graph.

    type: ``stored_procedure``, ``view``, ``function`` or ``table``. Modules with a definition are parsed; each statement
    is a node that its module contains, with what it reads and writes, or an unresolved one if its text is dynamic. Calls
    join modules, and reads of a view or function are uses by the module as well. Tables that nobody listed become nodes.
    Reads of temporary tables are followed to the base tables behind them.
    """
    listed = cut(listed_nodes(objects))
    specs = objects.filter("coalesce(trim(definition), '') <> ''").filter(F.col("type").isin(*MODULES))
    schema = F.when(F.coalesce("schema", F.lit("")) == "", "dbo").otherwise(F.col("schema"))
    texts = specs.select(node_id(F.col("type"), schema, F.col("name")).alias("module_id"), "definition").groupBy("module_id").agg(F.min("definition").alias("definition"))
    parsed = cut(tsql.operations(texts))
    errors = parsed.filter("error is not null").select("module_id", F.col("error").alias("message"))
    dynamic = (F.col("operation_type") == "DYNAMIC_SQL") | F.col("dynamic_sql")
    kind = F.when(dynamic, "unresolved_dynamic_sql").otherwise("dml_operation")
    held = F.when(F.size("conditions") > 0, F.col("conditions")).otherwise(F.col("branch_path"))
    ops = parsed.filter("error is null").join(listed.select(F.col("node_id").alias("module_id"), F.col("schema").alias("module_schema")), "module_id")
    ops = ops.withColumn("node_type", kind).withColumn("operation_id", F.concat_ws(":", "node_type", "module_id", F.col("sequence").cast("string"))).withColumn("conditions", held)
    statements = ops.filter("operation_type <> 'CALL'")
    refs = cut(resolved(_references(ops.filter(~dynamic)), listed, database))
    calls_away = F.concat(F.lit("stored_procedure:"), F.when(F.col("server") != "", F.concat("server", F.lit("."))).otherwise(""), "database", F.lit("."), "resolved_schema", F.lit("."), "name")
    named = F.when(F.col("node").isNotNull(), F.col("node")).when(F.col("role") == "calls", F.when(F.col("away"), calls_away).otherwise(node_id(F.lit("stored_procedure"), F.col("resolved_schema"), F.col("name"))))
    refs = refs.withColumn("target", F.coalesce(named, F.when(F.col("role") != "uses", node_id(F.lit("table"), F.col("resolved_schema"), F.col("name"), F.col("module_id"))))).filter("target is not null")
    none = F.array().cast("array<string>")

    def edges(rows: DataFrame, kind: Column, source: Column, target: Column, columns: Column = none, conditions: Column = none, confidence: str = "proven", stated: bool = True) -> DataFrame:
        part = lambda c: F.col(c) if stated else F.lit("")
        return rows.select(kind.alias("type"), source.alias("source"), target.alias("target"), part("schema_source").alias("schema_source"), part("database").alias("database"), part("server").alias("server"), "branch_path", conditions.alias("conditions"), columns.alias("columns"), F.lit(confidence).alias("confidence"), F.lit(None).cast("array<string>").alias("lineage"))

    module, operation, target, held = F.col("module_id"), F.col("operation_id"), F.col("target"), F.col("conditions")
    of_statements = refs.filter("role in ('reads', 'writes')")
    written = F.when(F.col("role") == "writes", F.col("written_columns")).otherwise(none)
    used = refs.filter("role = 'uses' or role = 'reads' and node is not null")
    found = edges(statements, F.lit("contains"), module, operation, stated=False)
    found = found.unionByName(edges(statements.filter(dynamic), F.lit("unresolved"), module, operation, conditions=held, confidence="unresolved", stated=False))
    found = found.unionByName(edges(of_statements, F.col("role"), operation, target, columns=written))
    found = found.unionByName(edges(used, F.lit("uses"), module, target, conditions=held))
    found = found.unionByName(edges(refs.filter("role = 'calls'"), F.lit("calls"), module, target, conditions=held))
    # a place in a row of references is no edge of its own
    found = cut(found.distinct().unionByName(_temp_reads(of_statements, refs, statements)))
    missing = of_statements.filter("node is null").select(F.col("target").alias("node_id"), F.lit("table").alias("type"), F.col("resolved_schema").alias("schema"), "name", F.when(is_scoped(F.col("name")), F.col("module_id")).alias("scope"))
    best = F.min(F.struct("schema", "name", "scope"))
    tables = missing.join(listed.select("node_id"), "node_id", "left_anti").groupBy("node_id", "type").agg(best.alias("b")).select("node_id", "type", "b.schema", "b.name", "b.scope")
    nodes = listed.unionByName(tables, allowMissingColumns=True)
    acts = statements.select(operation.alias("node_id"), F.col("node_type").alias("type"), F.lit("").alias("schema"), F.lit("").alias("name"), module.alias("module_id"), "operation_type", "sequence", "conditions")
    return Graph(nodes.unionByName(acts, allowMissingColumns=True), found, errors)


def _temp_reads(accesses: DataFrame, refs: DataFrame, statements: DataFrame) -> DataFrame:
    """A read of each base table behind a temporary one, for each read of that one; ``lineage`` is the chain of modules.

    A ``##`` table has one owner, so whoever fills it fills it for all.
    """
    owner = F.when(is_scoped(F.col("name")), F.col("module_id")).otherwise("")
    temp = accesses.filter("name like '#%'").withColumn("owner", owner).withColumn("temp", fold_key(F.col("name")))
    writes = temp.filter("role = 'writes'").select("operation_id", "owner", "temp")
    reads = accesses.filter("role = 'reads'").withColumn("is_temp", F.col("name").startswith("#")).withColumn("base", F.when(F.col("is_temp"), F.concat_ws("\x1f", fold_key(F.col("name")), F.when(is_scoped(F.col("name")), "").otherwise("##"))).otherwise(F.concat_ws("\x1f", "target", "server", "database")))
    filled = writes.join(reads.select("operation_id", "base", "is_temp", "schema_source"), "operation_id")
    # a global table's fills are everybody's: they stand in every module that reads it
    users = temp.filter("role = 'reads' and owner = ''").select("module_id", "temp").distinct()
    local = filled.filter("owner <> ''").select(F.col("owner").alias("module"), F.concat_ws("\x1f", "temp", F.lit("")).alias("temp"), "base", "schema_source")
    shared = filled.filter("owner = ''").join(users, "temp").select(F.col("module_id").alias("module"), F.concat_ws("\x1f", "temp", F.lit("##")).alias("temp"), "base", "schema_source")
    fills = cut(local.unionByName(shared))
    source = fills.groupBy("base").agg(F.min_by("schema_source", resolve.source_rank(F.col("schema_source"))).alias("schema_source"))
    into = statements.filter("operation_type = 'SELECT_INTO' and size(branch_path) = 0").select("operation_id")
    shadowed = writes.filter("owner <> ''").join(into, "operation_id", "left_semi").select(F.col("owner").alias("module"), F.concat_ws("\x1f", "temp", F.lit("")).alias("temp"))
    calls = refs.filter("role = 'calls' and node is not null").select(F.col("module_id").alias("source"), F.col("node").alias("target")).distinct()
    # only bases are tables: the name of a temporary one begins with #, that of a table's node does not
    behind = temp_table_lineage(fills.sparkSession, fills.select("module", "temp", "base").distinct(), calls, shadowed)
    asked = temp.filter("role = 'reads'").select("operation_id", "branch_path", F.col("module_id").alias("module"), F.concat_ws("\x1f", "temp", F.when(F.col("owner") == "", "##").otherwise("")).alias("temp")).distinct()
    got = asked.join(behind, ["module", "temp"]).join(source, "base", "left")
    part = F.split("base", "\x1f", -1)
    got = got.select(F.lit("reads").alias("type"), F.col("operation_id").alias("source"), F.get(part, 0).alias("target"), "schema_source", F.get(part, 2).alias("database"), F.get(part, 1).alias("server"), "branch_path", F.col("branch_path").alias("conditions"), F.array().cast("array<string>").alias("columns"), F.lit("proven").alias("confidence"), F.col("chain").alias("lineage"), "temp")
    shortest = got.withColumn("n", F.row_number().over(W.partitionBy("source", "target", "database", "server", "temp").orderBy(F.size("lineage"), "lineage")))
    return shortest.filter("n = 1").drop("n", "temp")
