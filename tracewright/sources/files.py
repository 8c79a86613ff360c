"""Source trees, stores and exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lexing import decoded

EXCLUDED_FOLDERS = ("bin", "obj", "node_modules", "packages", ".git", ".vs", "dist")
SOURCE, VIEWS = ("*.cs",), ("*.aspx", "*.ascx", "*.cshtml", "*.vue")


def scan(spark: SparkSession, root: str, patterns: tuple[str, ...] = SOURCE, exclude: tuple[str, ...] = ()) -> DataFrame:
    """``(path, content, content_hash)`` of the files under ``root`` by pattern, without excluded folders and globs.

    Paths are relative to the root, with ``/``. The pattern is given to the file listing, so other files are not read.
    """
    glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^file:/*", "/", root).rstrip("/")
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{re.escape(base)}/?", "")
    rows = files.select(path.alias("path"), "content")
    folders = "|".join(map(re.escape, EXCLUDED_FOLDERS))
    rows = rows.filter(~F.col("path").rlike(rf"(?i)(^|/)({folders})/"))
    for e in exclude:
        rows = rows.filter(~F.col("path").rlike("(?i)^" + re.escape(e).replace(r"\*", ".*").replace(r"\?", ".") + "$"))
    return rows.select("path", decoded("content").alias("content"), F.sha2("content", 256).alias("content_hash"))


def store(df: DataFrame, path: str, version: int, *partitions: str) -> None:
    """Write a store with its format version; a store is replaced as a whole."""
    writer = df.withColumn("format_version", F.lit(version)).write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def load(spark: SparkSession, path: str, version: int) -> DataFrame:
    """What a store holds in this format; rows of another version are not read."""
    return spark.read.parquet(path).filter(F.col("format_version") == version).drop("format_version")


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_excel(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook on the driver, of reports of bounded size; needs an Excel writer that pandas knows."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            df.toPandas().to_excel(book, sheet_name=name, index=False)
