"""Written object names and their comparison keys.

A name has up to four dotted parts, read from the right: server, database, schema, name. An empty part means "not
stated". Keys are case folded.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

DEFAULT_SCHEMA, SYSTEM_SCHEMA = "dbo", "sys"
#: Schema sources, strongest first.
SOURCES = ("written", "module_schema", "default_schema", "system", "unresolved")


@pandas_udf(StringType())
def _casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def fold_key(text: Column) -> Column:
    """Case folding. ASCII stays in the JVM; other text needs the full rule, which ``lower`` does not follow."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lower(text)).otherwise(_casefold(text))


def ascii_key(text: Column) -> Column:
    """``fold_key`` of names known to be ASCII: it has no Python branch in the plan."""
    return F.lower(text)


def unbracketed(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "[]", "")


def parse(written: Column) -> Column:
    """STRUCT<server, database, schema, name>; missing parts are '', parts beyond four are dropped from the left."""
    parts = F.transform(F.split(unbracketed(written), r"\."), lambda p: F.trim(p))
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    return F.struct(at(4).alias("server"), at(3).alias("database"), at(2).alias("schema"), at(1).alias("name"))


def bare_key(name: Column, key=fold_key) -> Column:
    return key(name["name"])


def full_key(name: Column, key=fold_key) -> Column:
    """``database.schema.name``, always three segments."""
    return F.concat(key(name["database"]), F.lit("."), key(name["schema"]), F.lit("."), key(name["name"]))


def part_key(part: Column, key=fold_key) -> Column:
    """The key of one part alone, which may hold dots."""
    return key(F.trim(unbracketed(part)))


def schema_qualified(name: Column) -> Column:
    return F.when((name["schema"] != "") & (name["name"] != ""), F.concat(name["schema"], F.lit("."), name["name"])).otherwise(name["name"])


def source_rank(source: Column) -> Column:
    """0 for the strongest schema source; unknown ones are the weakest."""
    rank = F.lit(len(SOURCES))
    for i, s in enumerate(SOURCES):
        rank = F.when(source == s, i).otherwise(rank)
    return rank


def recorded_source(source: Column, schema: Column) -> Column:
    """The source that a record states; one that states none is written if its target has a schema."""
    return F.when(F.coalesce(source, F.lit("")) != "", source).when(F.coalesce(schema, F.lit("")) != "", "written").otherwise("unresolved")


def server_key(server: Column, domain: str = "") -> Column:
    """A server's cache key: protocol, port and instance dropped, the domain added to a bare host, lower case."""
    host = F.regexp_replace(F.trim(server), r"(?i)^tcp:", "")
    host = F.lower(F.trim(F.regexp_replace(F.split_part(host, F.lit(","), F.lit(1)), r"\\.*$", "")))
    return F.when((host != "") & ~host.contains(".") & (F.lit(domain) != ""), F.concat(host, F.lit(domain))).otherwise(host)
