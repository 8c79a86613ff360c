"""Reports over fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_statistics(files: DataFrame, calls: DataFrame, tables: DataFrame) -> DataFrame:
    """One row: files, calls, distinct procedures (in lower case), distinct tables, databases."""
    f = files.agg(F.countDistinct("file").alias("total_files"))
    c = calls.agg(F.count("*").alias("sp_calls"), F.countDistinct(F.lower("procedure")).alias("unique_sps"), F.countDistinct("database").alias("databases"))
    t = tables.agg(F.countDistinct("table").alias("unique_tables"))
    return f.join(c, how="cross").join(t, how="cross")  # one row each


def frequency(rows: DataFrame, key: str, count: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(count))


def database_summary(calls: DataFrame) -> DataFrame:
    return calls.groupBy("database").agg(F.countDistinct("procedure").alias("procedures"), F.countDistinct("file").alias("files"))


def kind_counts(objects: DataFrame) -> DataFrame:
    """``objects(database, kind)`` -> how many objects of each of the four kinds a database has."""
    kinds = ("procedures", "views", "functions", "tables")
    return objects.groupBy("database").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def procedure_list(calls: DataFrame) -> DataFrame:
    """``calls(procedure, file)`` -> each procedure with its calls and the files that call it."""
    return calls.groupBy("procedure").agg(F.count("*").alias("calls"), F.array_join(F.sort_array(F.collect_set("file")), ",").alias("callers"))


def impact(calls: DataFrame) -> DataFrame:
    """calls * 2 + distinct files * 3 of each procedure."""
    agg = calls.groupBy("procedure").agg(F.count("*").alias("calls"), F.countDistinct("file").alias("files"))
    return agg.withColumn("impact", F.col("calls") * 2 + F.col("files") * 3)


def edge_weights(calls: DataFrame, source: str, target: str) -> DataFrame:
    return calls.groupBy(source, target).agg(F.count("*").alias("weight"))


def table_usage(relations: DataFrame) -> DataFrame:
    """Access types and number of files of each table."""
    return relations.groupBy("table").agg(F.array_join(F.sort_array(F.collect_set("access_type")), ",").alias("access_types"), F.countDistinct("file").alias("files"))


def ratio(part: Column, total: Column) -> Column:
    """A share to four places, null without a total."""
    return F.when(total > 0, F.round(part / total, 4))


def coverage(rows: DataFrame) -> DataFrame:
    """``rows(system, root, resolved, reason)`` -> totals of each scan root and, with a null root, of each system."""
    sets = rows.cube("system", "root").agg(F.count("*").alias("total"), F.count_if("resolved").alias("resolved_count"), F.grouping("system").alias("g1"), F.grouping("root").alias("g2"))
    return sets.filter("g1 = 0").select("system", "root", "total", "resolved_count", ratio(F.col("resolved_count"), F.col("total")).alias("share"))


def reasons(rows: DataFrame) -> DataFrame:
    """Reason counts of each system, with the place of each by count and then code."""
    from pyspark.sql import Window as W

    n = rows.filter("not resolved").groupBy("system", "reason").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("system").orderBy(F.desc("n"), "reason")))


def evidence_summary(rows: DataFrame, key: str) -> DataFrame:
    """Counts of each evidence status by key; a status without rows stays as zero."""
    return rows.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("evidence") == e).alias(e) for e in ("proven", "likely", "unresolved")])


def exclusion_candidates(rows: DataFrame) -> DataFrame:
    """``rows(system, class_name, method_name, resolved)`` -> wrapper methods that are never resolved in a system.

    systems: those that have it; resolved_elsewhere: whether another call of the method is resolved in any.
    """
    agg = rows.groupBy("class_name", "method_name").agg(
        F.count_if(~F.col("resolved")).alias("unresolved"), F.array_join(F.sort_array(F.collect_set(F.when(~F.col("resolved"), F.col("system")))), ",").alias("systems"), F.max("resolved").alias("resolved_elsewhere")
    )
    tier = F.when(~F.col("resolved_elsewhere"), "method").otherwise("call_site")
    return agg.filter("unresolved > 0").withColumn("tier", tier)


def procedure_score(n_tables: Column, n_joins: Column, has_where: Column, n_calls: Column) -> Column:
    return n_tables * 2 + n_joins * 3 + has_where.cast("int") + n_calls * 5


def rebuild_report(references: DataFrame) -> DataFrame:
    """``references(schema_source, target, is_cte, is_alias_write)`` -> one row of a rebuilt graph's totals."""
    return references.agg(
        F.count_if(F.col("schema_source") == "unresolved").alias("empty_schema"),
        F.count_if("is_cte").alias("cte_reads"),
        F.count_if("is_alias_write").alias("alias_writes"),
        F.countDistinct(F.when(F.col("schema_source") == "unresolved", F.col("target"))).alias("unproven_targets"),
    )


def oldest_saved(caches: DataFrame) -> DataFrame:
    """Of the roots of each system: the oldest time saved, and whether all can be used."""
    return caches.groupBy("system").agg(F.min("saved_at").alias("oldest"), F.bool_and("usable").alias("usable"))


def fingerprint(objects: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``objects(database, type, modified)`` -> count and latest change of each kind group."""
    kind = F.lit(None).cast("string")
    for t, k in kinds.items():
        kind = F.when(F.col("type") == t, k).otherwise(kind)
    return objects.withColumn("kind", kind).filter("kind is not null").groupBy("database", "kind").agg(F.count("*").alias("n"), F.max("modified").alias("latest"))


def collisions(objects: DataFrame) -> DataFrame:
    """Names that a kind has in more than one schema."""
    agg = objects.groupBy("kind", "key").agg(F.array_join(F.sort_array(F.collect_set("schema")), ",").alias("schemas"), F.countDistinct("schema").alias("n"))
    return agg.filter("n > 1")


def freshness(caches: DataFrame) -> DataFrame:
    """``caches(cache, refreshing, format_ok, behind)`` -> refreshing > outdated > behind_source > current."""
    state = F.when(F.col("refreshing"), "refreshing").when(~F.col("format_ok"), "outdated").when(F.col("behind"), "behind_source").otherwise("current")
    return caches.select("cache", state.alias("state"))


def merge_scans(scans: DataFrame) -> DataFrame:
    """``scans(system, ord, files, calls, source)`` -> sums, and the source of the later scan."""
    return scans.groupBy("system").agg(F.sum("files").alias("files"), F.sum("calls").alias("calls"), F.max_by("source", "ord").alias("source"))


def data_status(systems: DataFrame, clones: DataFrame, scans: DataFrame) -> DataFrame:
    """``systems(system)``, ``clones(system)``, ``scans(system, outdated)`` -> state of each system's clone and scan."""
    c = clones.select("system").distinct().withColumn("cloned", F.lit(True))
    s = scans.groupBy("system").agg(F.max("outdated").alias("old"))
    joined = systems.join(c, "system", "left").join(s, "system", "left")
    scan = F.when(F.col("old").isNull(), "missing").when(F.col("old"), "outdated").otherwise("current")
    return joined.select("system", F.when(F.col("cloned"), "cloned").otherwise("missing").alias("clone"), scan.alias("scan"))
