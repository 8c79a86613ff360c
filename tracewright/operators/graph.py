"""Iterative graph operators: bounded expansion, reachability, fixed points, chains.

Loops stop by a count; only counts reach the driver. Lineage is cut by ``checkpoint`` in the shared folder, so that a
lost executor costs no more than the round it was lost in.
"""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CALL_DEPTH = 5


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the folder the cluster names in spark.checkpoint.dir; a local session may have one of its own."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    with _set(spark, "spark.sql.constraintPropagation.enabled", "false"), _set(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return df.checkpoint(eager=True)


@contextlib.contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting for what runs inside. A checkpoint keeps what its plan knows of its columns, and the next round derives
    more from it, so without a cut of that as well a condition grows by a power of the rounds."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Levels:
    """Rows of the rounds of a loop, each materialised once; every MANY rounds they become one table."""

    MANY = 8

    def __init__(self, first: DataFrame):
        self.tables = [first]

    def add(self, level: DataFrame) -> None:
        self.tables.append(level)
        if len(self.tables) > self.MANY:
            self.tables = [cut(self.rows())]

    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables)


def expand_bounded(entries: DataFrame, calls: DataFrame, max_depth: int = MAX_CALL_DEPTH) -> DataFrame:
    """``entries(module)``, ``calls(source, target)`` as a bag -> ``(entry, module, chain, status)``.

    status: ``ok``, ``stored_procedure_call_cycle`` (the module is in the chain before it) or
    ``call_expansion_truncated`` (more than ``max_depth`` modules before it); the cycle is looked for first and neither
    is expanded further. Duplicate calls give duplicate chains. Each level is materialised once.
    """
    level = entries.select(F.col("module").alias("entry"), "module", F.array("module").alias("chain"), F.lit("ok").alias("status"))
    found = level
    for depth in range(1, max_depth + 2):
        ahead = level.filter("status = 'ok'").select("entry", F.col("module").alias("source"), "chain")
        level = cut(ahead.join(calls.select("source", "target"), "source").select(
            "entry",
            F.col("target").alias("module"),
            F.concat("chain", F.array("target")).alias("chain"),
            F.when(F.array_contains("chain", F.col("target")), "stored_procedure_call_cycle")
            .when(F.lit(depth > max_depth), "call_expansion_truncated")
            .otherwise("ok")
            .alias("status"),
        ))
        found = found.unionByName(level)
    return found


def reach(starts: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``starts(origin, node)``, ``edges(source, target)`` -> ``(origin, node, depth)``: everything reachable, once, at its least depth."""
    edges = cut(edges.select("source", "target").distinct())
    frontier = cut(starts.select("origin", "node").distinct().withColumn("depth", F.lit(0)))
    seen = Levels(frontier)
    for depth in range(1, max_rounds + 1):
        ahead = frontier.join(edges, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node")).distinct()
        frontier = cut(ahead.join(seen.rows(), ["origin", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen.rows()
        seen.add(frontier)
    raise RuntimeError("reach did not end")


def reach_with_free_edges(starts: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """As ``reach``, where ``edges(source, target, cost)`` of cost 0 stay on their level and others go to the next."""
    free, paid = (edges.filter(F.col("cost") == c).select("source", "target") for c in (0, 1))
    seen = reach(starts, free).select("origin", "node").withColumn("depth", F.lit(0))
    level = seen
    for depth in range(1, max_depth + 1):
        ahead = level.join(paid, F.col("node") == F.col("source")).select("origin", F.col("target").alias("node")).distinct()
        fresh = ahead.join(seen, ["origin", "node"], "left_anti")
        closed = reach(fresh, free).select("origin", "node").join(seen, ["origin", "node"], "left_anti")
        level = cut(closed.distinct().withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level))
    return seen


def temp_table_lineage(spark: SparkSession, selects: DataFrame, calls: DataFrame, shadowed: DataFrame | None = None) -> DataFrame:
    """Base tables behind the temporary tables a module uses.

    ``selects(module, temp, base)``: the module fills ``temp`` from ``base``, which is a base table or another temp
    table (``#``); ``calls(source, target)``. A temp table is looked for up the callers or down the callees of the module
    that uses it, and what fills it there is looked for in the same direction: the two are never mixed. A name in
    ``shadowed(module, temp)`` is the module's own: nobody looks up out of that module for it, or down into it.
    -> ``(module, temp, base, chain)``: the shortest chain of modules, the first by name of those.
    """
    keys = ["module", "temp", "base", "way"]
    own = selects.select("module", "temp", "base", F.array("module").alias("chain"), F.explode(F.array(*map(F.lit, ("up", "down", "here")))).alias("way"))
    shadowed = (shadowed if shadowed is not None else selects.limit(0)).select(F.col("module").alias("own_module"), F.col("temp").alias("own_temp")).distinct()
    # what is filled from a temp table of the same module, over whatever temp tables between
    at = lambda c: F.struct("module", F.col(c).alias("temp"))
    inner = selects.join(selects.select(F.col("temp").alias("base")).distinct(), "base", "left_semi").select(at("base").alias("source"), at("temp").alias("target"))
    passes = cut(reach(inner.select(F.col("source").alias("origin"), F.col("source").alias("node")), inner).filter("depth > 0").select(F.col("origin.module").alias("in_module"), F.col("origin.temp").alias("from_temp"), F.col("node.temp").alias("to_temp")))

    def free(states: DataFrame, module: str) -> DataFrame:
        return states.join(shadowed, (F.col(module) == F.col("own_module")) & (F.col("temp") == F.col("own_temp")), "left_anti")

    def moved(states: DataFrame) -> DataFrame:
        # what a caller sees looking up, its callees see looking up; what a callee sees looking down, its callers see
        called = free(states.filter("way = 'up'").join(calls, F.col("module") == F.col("source")), "target").select(F.col("target").alias("module"), "temp", "base", F.concat(F.array("target"), "chain").alias("chain"), "way")
        caller = free(states.filter("way = 'down'"), "module").join(calls, F.col("module") == F.col("target")).select(F.col("source").alias("module"), "temp", "base", F.concat(F.array("source"), "chain").alias("chain"), "way")
        both = called.unionByName(caller)
        return both.withColumn("way", F.explode(F.array("way", F.lit("here"))))

    def settled(states: DataFrame) -> DataFrame:
        through = states.join(passes, (F.col("module") == F.col("in_module")) & (F.col("temp") == F.col("from_temp"))).select("module", F.col("to_temp").alias("temp"), "base", "chain", "way")
        return states.unionByName(through).groupBy(*keys).agg(F.min("chain").alias("chain"))

    # a round finds the chains that are longer by one, so a state is final when it is first found and is written once
    level = cut(settled(own))
    seen = Levels(level)
    seen.MANY = 64
    while not level.isEmpty():
        known = seen.rows().select(*[F.col(k).alias(f"known_{k}") for k in keys])
        same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"known_{k}")) for k in keys))
        level = cut(settled(moved(level)).join(known, same, "left_anti"))
        seen.add(level)
    return seen.rows().filter((F.col("way") == "here") & ~F.col("base").startswith("#")).select("module", "temp", "base", "chain")


def container_lineage(reads: DataFrame) -> DataFrame:
    """``reads(container, target, is_container)`` -> ``(container, base)``: base tables behind views and functions."""
    edges = reads.filter("is_container").select(F.col("container").alias("source"), "target")
    starts = reads.select(F.col("container").alias("origin"), F.col("container").alias("node")).distinct()
    inside = reach(starts, edges)
    bases = reads.filter("not is_container").select(F.col("container").alias("node"), F.col("target").alias("base"))
    return inside.join(bases, "node").select(F.col("origin").alias("container"), "base").distinct()


def simple_paths(starts: DataFrame, edges: DataFrame, max_nodes: int = 4) -> DataFrame:
    """Paths without repeated nodes of 2 to ``max_nodes`` nodes that begin at ``starts(node)``: ``(start, chain)``."""
    edges = edges.select("source", "target").distinct()
    level = starts.select(F.col("node").alias("start"), F.array("node").alias("chain"))
    found = None
    for _ in range(max_nodes - 1):
        level = level.join(edges, F.element_at("chain", -1) == F.col("source")).filter(~F.array_contains("chain", F.col("target")))
        level = level.select("start", F.concat("chain", F.array("target")).alias("chain"))
        found = level if found is None else found.unionByName(level)
    return found


def root_chains(starts: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Reverse chains from ``starts(node)`` to entries: ``(node, root, chain)``, the caller first, of any length.

    A chain ends at a node without callers, or where it meets itself. For each node and root the longest chain, then the
    last by name, is kept. A chain that meets itself has no root and goes, but for the one that is the longest, then the
    last, of all chains of its node: the node has no less than one.
    """
    calls = edges.select("source", "target").distinct()
    heads = calls.select(F.col("target").alias("called")).distinct()
    level = starts.select("node", F.array("node").alias("chain"), F.lit(False).alias("meets"))
    done = None
    for _ in range(max_rounds):
        open_ = level.filter("not meets").join(heads, F.element_at("chain", 1) == F.col("called"), "left_semi")
        ends = level.filter("meets").unionByName(level.filter("not meets").join(heads, F.element_at("chain", 1) == F.col("called"), "left_anti"))
        if done is None:
            done = Levels(cut(ends))
        else:
            done.add(cut(ends))
        longer = open_.join(calls, F.element_at("chain", 1) == F.col("target"))
        level = cut(longer.select("node", F.concat(F.array("source"), "chain").alias("chain"), F.array_contains("chain", F.col("source")).alias("meets")))
        if level.isEmpty():
            break
    else:
        raise RuntimeError("chains did not end")
    rank = F.max(F.struct(F.size("chain").alias("n"), F.col("chain").alias("chain"), "meets"))
    best = done.rows().groupBy("node", F.element_at("chain", 1).alias("root"), "meets").agg(rank.alias("b"))
    top = best.groupBy("node").agg(F.max("b").alias("top"))
    kept = best.join(top, "node").filter(~F.col("meets") | (F.col("b") == F.col("top")))
    kept = kept.groupBy("node", "root").agg(F.max("b").alias("b"))
    return kept.select("node", "root", F.col("b.chain").alias("chain"))


def joined(chain: Column) -> Column:
    """A chain as text, for output and comparison."""
    return F.array_join(chain, ">")
