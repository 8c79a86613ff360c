"""Deduplication by rank, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import cut


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. An aggregate of one struct: it sums up before the shuffle, unlike a window."""
    rest = [c for c in rows.columns if c not in keys]
    names = [f"_o{i}" for i in range(len(order))]
    packed = F.min(F.struct(*[o.alias(n) for o, n in zip(order, names)], *rest)).alias("_best")
    return rows.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest])


def access_rank(access: Column) -> Column:
    """2 for a write, 1 for a read, 0 for others."""
    return F.when(access.isin("WRITE", "INSERT", "UPDATE", "DELETE", "MERGE", "SELECT_INTO", "WRITE_INDIRECT"), 2).when(access.isin("READ", "READ_INDIRECT"), 1).otherwise(0)


def strongest_match(rows: DataFrame, identity: list[str]) -> DataFrame:
    """One table match per identity: writes first, then direct ones, then those by a procedure, then in order."""
    return first_by(rows, identity, -access_rank(F.col("access_type")), F.col("is_indirect"), -F.col("via_procedure").cast("int"), F.col("ord"))


def inline_match(rows: DataFrame) -> DataFrame:
    """One inline match of each file: a direct read before one through a view or function, then by strength and in order."""
    return first_by(rows, ["file"], F.col("read_through"), -access_rank(F.col("access_type")), F.col("is_indirect"), -F.col("via_procedure").cast("int"), F.col("ord"))


def ranged(rows: DataFrame, order: list[Column], place: str = "position") -> DataFrame:
    """``rows`` in an order over all of them, with their place from 0: dealt to ranges, which are counted and not gathered.

    The columns of ``order`` have to tell all rows apart. The ranges come from a sample and may be merged at run time, so
    they are materialised before they are counted: dealt twice, they would not be the same.
    """
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range
    starts = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    numbered = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return numbered.withColumn(place, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")


def path_order() -> list[Column]:
    """Paths by file and span, entry, chain, operation, reason and id."""
    return [F.col(c) for c in ("file", "start", "end", "entry_method", "chain", "operation_no", "unresolved_reason", "path_id")]


def access_order() -> list[Column]:
    """Accesses by entry, path and access type."""
    return [F.col(c) for c in ("entry_method", "path_id", "access_type")]


def first_of_each(rows: DataFrame, key: str, most: int, *order: Column) -> DataFrame:
    """The first ``most`` rows of each key in their order of discovery, with their place from 1."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("place") <= most)


def without_outranked(inline: DataFrame, graph: DataFrame) -> DataFrame:
    """Inline matches of files in which no graph match has a higher rank."""
    best = graph.groupBy(F.col("file").alias("_file")).agg(F.max(access_rank(F.col("access_type"))).alias("_rank"))
    return inline.join(best, (F.col("file") == F.col("_file")) & (F.col("_rank") > access_rank(F.col("access_type"))), "left_anti")


def latest(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key; ties go to the larger ``tie``."""
    rest = [c for c in rows.columns if c not in (key, at, tie)]
    best = rows.groupBy(key).agg(F.max(F.struct(at, tie, *rest)).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in (at, tie, *rest)])


def prune(rows: DataFrame, key: str, at: str, tie: str, most: int) -> DataFrame:
    """The ``most`` latest rows and the latest of each key besides."""
    newest = rows.orderBy(F.desc(at), F.desc(tie)).limit(most)
    return newest.unionByName(latest(rows, key, at, tie).select(rows.columns)).distinct()


def queue_position(rows: DataFrame, queue: str, at: str, tie: str) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(W.partitionBy(queue).orderBy(at, tie)) - 1)


def before(points: DataFrame, values: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``points`` with the value that the key had last before (not at) each point."""
    union = values.select(key, at, value, F.lit(1).alias("_kind")).unionByName(points.select(key, at, F.lit(None).cast(values.schema[value].dataType).alias(value), F.lit(0).alias("_kind")))
    seen = F.last(value, ignorenulls=True).over(W.partitionBy(key).orderBy(at, "_kind", value).rowsBetween(W.unboundedPreceding, W.currentRow))
    return union.withColumn(value, seen).filter("_kind = 0").drop("_kind")


def top(rows: DataFrame, k: int, *order: Column, most: int = 60) -> DataFrame:
    """The first ``k`` rows (0 to ``most``) with their position; the sort keeps k rows a task."""
    cut = rows.orderBy(*order).limit(min(most, max(0, k)))
    return cut.withColumn("position", F.row_number().over(W.orderBy(*order)))


def compact(paths: DataFrame, k: int = 20) -> DataFrame:
    """Compact top-k of ``paths(path_id, n_writes, keyword_hits, entry_hits)`` with the totals of the answer."""
    total = paths.agg(F.count("*").alias("total"))
    cut = top(paths, k, (F.col("n_writes") == 0).cast("int"), F.desc("keyword_hits"), F.desc("entry_hits"), F.col("path_id"))
    return cut.join(F.broadcast(total), how="cross").withColumn("omitted", F.col("total") - F.count("*").over(W.partitionBy()))


def keyword_hits(text: Column, question: str) -> Column:
    """How often words of the question of more than one character are in the text; a repeated word counts again."""
    import re

    words = [w.lower() for w in re.findall(r"\w+", question) if len(w) > 1]
    hits = F.lit(0)
    for w in words:
        hits = hits + F.lower(text).contains(w).cast("int")
    return hits
