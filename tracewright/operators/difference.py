"""Difference reports and incremental refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def refresh(stored: DataFrame, parsed: DataFrame, affected: DataFrame, key: str = "path") -> DataFrame:
    """Rows of files that are not affected, and what was parsed of those that are."""
    return stored.join(affected.select(key).distinct(), key, "left_anti").unionByName(parsed.join(affected.select(key).distinct(), key, "left_semi"))


def removed(stored: DataFrame, current: DataFrame, key: str = "path") -> DataFrame:
    return stored.select(key).distinct().join(current.select(key), key, "left_anti")


def multiset_diff(left: DataFrame, right: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Full outer pairing of rows of one identity by their rank on each side: ``pair`` is both, left_only or right_only."""
    ranked = lambda d, side: d.withColumn("rank", F.row_number().over(W.partitionBy(*identity).orderBy(order))).select(*identity, "rank", F.lit(1).alias(side))
    joined = ranked(left, "l").join(ranked(right, "r"), [*identity, "rank"], "full_outer")
    pair = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return joined.select(*identity, "rank", pair.alias("pair"))


def surface_diff(old: DataFrame, new: DataFrame, key: str, behavior: str) -> DataFrame:
    """missing, added, behavior_changed and same of two versions' operations."""
    o, n = old.select(key, F.col(behavior).alias("old_behavior")), new.select(key, F.col(behavior).alias("new_behavior"))
    state = F.when(F.col("new_behavior").isNull(), "missing").when(F.col("old_behavior").isNull(), "added").when(F.col("old_behavior") != F.col("new_behavior"), "behavior_changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, state.alias("state"))


def graph_diff(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges ``(module, source, target, type)`` on one side only, of modules whose definition didn't change."""
    kept = lambda d: d.select("module", "source", "target", "type").distinct().join(changed.select("module").distinct(), "module", "left_anti")
    a, b = kept(old), kept(new)
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))


def affected_scopes(dependencies: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Scopes that depend on a refreshed cache."""
    return dependencies.join(refreshed.select("cache").distinct(), "cache", "left_semi").select("scope").distinct()


def expand_targets(wanted: DataFrame, roots: DataFrame) -> DataFrame:
    """``wanted(system)``, ``roots(system, root, exists)`` -> a row for each root, or a reason why there is none."""
    joined = wanted.distinct().join(roots, "system", "left")
    reason = F.when(F.col("root").isNull(), "unknown_system").when(~F.col("exists"), "root_not_found").otherwise("")
    return joined.select("system", "root", reason.alias("reason"))
