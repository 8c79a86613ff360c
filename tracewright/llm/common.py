"""Helpers shared by the operators: table access, lineage cuts, skew-safe lookups, components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than 1/HOT_SHARE of the rows; so at most HOT_SHARE keys are hot.
HOT_SHARE = 500
#: Edges of one checkpoint file, about.
EDGES = 250_000
#: Parts that a table is put through one after another where its shuffle is as large as itself.
SLICES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: of spark.checkpoint.dir, or in a local session one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors lose nothing and lineage ends here."""
    shared_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        return df.checkpoint(eager=True)


def stored(df: DataFrame, onto: DataFrame | None = None) -> DataFrame:
    """As ``cut``, in a compact columnar table: for wide rows and for many; added to those ``onto``. ``discard`` removes it."""
    folder = onto._folder if onto is not None else f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_removed(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def stored_by_slice(df: DataFrame, *keys: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of each of SLICES parts of ``df`` by a hash of the keys, stored in one table.

    A part is removed when it is done, as are its shuffle files, so the disk holds those of one part at a time.
    """
    spark, most = df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    folder, (name,) = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}", fresh(df, "slice")
    before = spark.conf.get(most, None)
    spark.conf.set(most, str(SLICES))  # a file for each part at once, so that nothing is sorted
    try:
        with _shuffles_removed(spark):
            parted = df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int"))
            parted.write.partitionBy(name).option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(most) if before is None else spark.conf.set(most, before)
    whole, out = spark.read.schema(parted.schema).parquet(folder), None
    for i in range(SLICES):
        out = stored(step(whole.filter(F.col(name) == i).drop(name)), out)
        _remove(spark, f"{folder}/{name}={i}")
    _remove(spark, folder)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no result still reads."""
    for df in tables:
        _remove(df.sparkSession, df._folder)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: once a table is in the shared folder nobody reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have, in either case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n. Null ids fold as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup(left: DataFrame, right: DataFrame, key: str, copies: str, spread: str) -> DataFrame:
    """Left join ``left`` with ``right`` (one row per ``key``; ``copies``: how many left rows have the key).

    Keys above 1/HOT_SHARE of all left rows, HOT_SHARE at most, are broadcast; their left rows are spread by
    ``spread`` in the shuffle join that serves the other keys, so no task gets a hot key's rows.
    """
    values = [c for c in right.columns if c not in (key, copies)]
    total = right.agg(F.sum(copies)).first()[0] or 0
    hot = right.filter(F.col(copies) > max(1000, total // HOT_SHARE)).select(
        F.col(key).alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    cold = right.select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), *[F.col(v).alias(f"_cold_{v}") for v in values])
    with_hot = left.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    salted = with_hot.withColumn(
        "_salt", F.when(F.col("_hot_key").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1024)).cast("int"))
    )
    joined = salted.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    return joined.select(
        *[F.col(c) for c in left.columns], *[F.coalesce(f"_hot_{v}", f"_cold_{v}").alias(v) for v in values]
    )


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``edges(a, b)`` of one type, links in either direction -> ``(node, root)``, root the smallest node reachable.

    Alternating large-star and small-star rounds; each is two aggregations with partial sums and joins, so a node
    with very many neighbours is never gathered. Only a count and a checksum reach the driver. Null ends and loops
    are dropped; an empty input gives an empty result.
    """
    now = cut(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(low.select(F.col("u"), F.col("m")))
        # edges become no more, so a small set is kept in few files; a round of a large one keeps its partitions
        now = cut(small.distinct().coalesce(before[0] // EDGES + 1))
        after = mark(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
