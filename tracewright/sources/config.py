"""Connections from configuration files."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVER_KEYS = ("server", "data source", "address", "addr", "network address")
DATABASE_KEYS = ("database", "initial catalog")
ENTRY = "path string, namespace string, key string, value string, ord int, stops boolean"


def connection_parts(text: Column) -> Column:
    """STRUCT<server, database> of ``k=v;`` pairs; the first of a kind wins, credentials are not kept."""
    pairs = F.transform(F.filter(F.split(text, ";"), lambda p: p.contains("=")), lambda p: F.struct(F.lower(F.trim(F.split_part(p, F.lit("="), F.lit(1)))).alias("k"), F.trim(F.regexp_replace(p, r"^[^=]*=", "")).alias("v")))
    first = lambda keys: F.coalesce(F.get(F.filter(pairs, lambda p: p["k"].isin(*keys)), 0)["v"], F.lit(""))
    return F.struct(first(SERVER_KEYS).alias("server"), first(DATABASE_KEYS).alias("database"))


def _web_config(text: str) -> Iterator[tuple]:
    """Adds, removes and clears in document order; sections of a <location> belong to its path."""
    try:
        root = ET.fromstring(re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError:
        return
    places = [("", root), *[(e.get("path", ""), e) for e in root.iter("location")]]
    for place, node in places:
        for section, namespace, name, value in (("connectionStrings", "connection_strings", "name", "connectionString"), ("appSettings", "app_settings", "key", "value")):
            own = node.find(section)
            for entry in own if own is not None else []:
                tag = entry.tag.lower()
                prefix = f"{namespace}@{place}" if place else namespace
                if tag == "add":
                    yield prefix, entry.get(name, ""), entry.get(value, ""), False
                elif tag in ("remove", "clear"):
                    yield prefix, entry.get(name, "") if tag == "remove" else "*", None, True


def _without_json_comments(text: str) -> str:
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)


def _app_settings(text: str) -> Iterator[tuple]:
    """ConnectionStrings entries, and every leaf by its path with colons."""
    try:
        data = json.loads(re.sub(r",(\s*[}\]])", r"\1", _without_json_comments(text.lstrip("\ufeff"))))
    except ValueError:
        return

    def leaves(node: object, path: list[str]) -> Iterator[tuple[str, str]]:
        if isinstance(node, dict):
            for k, v in node.items():
                yield from leaves(v, [*path, k])
        elif node is not None and not isinstance(node, list):
            yield ":".join(path), str(node)

    for path, value in leaves(data, []):
        head, _, rest = path.partition(":")
        yield ("connection_strings", rest, value, False) if head == "ConnectionStrings" and rest else ("root_configuration", path, value, False)


def _composition_root(text: str) -> Iterator[tuple]:
    """The lookup key of each registered context: AddDbContext<T>(... GetConnectionString("key") ...)."""
    seen = set()
    for m in re.finditer(r"AddDbContext(?:Pool|Factory)?\s*<\s*(?:\w+\s*,\s*)?([\w.]+)\s*>\s*\(", text):
        depth, at = 1, m.end()
        while at < len(text) and depth:
            depth += (text[at] == "(") - (text[at] == ")")
            at += 1
        key = re.search(r'GetConnectionString\(\s*"([^"]+)"|\["ConnectionStrings:([^"]+)"\]', text[m.end() : at])
        name = m[1].rpartition(".")[2]
        if key and name not in seen:
            seen.add(name)
            yield "db_context", name, key[1] or key[2], False


def _resources(text: str) -> Iterator[tuple]:
    try:
        for d in ET.fromstring(re.sub(r"^\ufeff?\s*<\?xml[^>]*\?>", "", text)).iter("data"):
            yield "resource", d.get("name", ""), d.findtext("value") or "", False
    except ET.ParseError:
        return


PARSERS: dict[str, Callable[[str], Iterator[tuple]]] = {"web_config": _web_config, "appsettings": _app_settings, "composition_root": _composition_root, "resx": _resources}


def entries(files: DataFrame, parser: str) -> DataFrame:
    """``files(path, content)`` -> entries in document order; a file that can't be read has none."""
    parse = PARSERS[parser]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, k, v, i, s) for p, c in zip(batch["path"], batch["content"]) for i, (n, k, v, s) in enumerate(parse(c or ""))]
            yield pd.DataFrame(rows, columns=["path", "namespace", "key", "value", "ord", "stops"]).astype({"ord": "int32", "stops": bool})

    return files.select("path", "content").mapInPandas(run, ENTRY)


def table(entries: DataFrame) -> DataFrame:
    """The entries in force: those added after the last remove or clear of their key; the last of a key wins."""
    stops = entries.filter("stops").groupBy("path", "namespace", F.col("key").alias("stop_key")).agg(F.max("ord").alias("stop_at"))
    live = entries.filter("not stops").join(stops, ["path", "namespace"], "left").groupBy("path", "namespace", "key", "value", "ord")
    kept = live.agg(F.max(F.when(F.col("stop_key").isin("*") | (F.col("stop_key") == F.col("key")), F.col("stop_at"))).alias("at")).filter("at is null or at < ord")
    return kept.groupBy("path", "namespace", "key").agg(F.max_by("value", "ord").alias("value"))


def display_text(fields: DataFrame, resources: DataFrame) -> DataFrame:
    """``fields(field, resource, key)`` with their text, or the reason why there is none."""
    held = resources.select("resource", "key", "value")
    joined = fields.join(held, ["resource", "key"], "left").join(resources.select("resource").distinct().withColumn("found", F.lit(True)), "resource", "left")
    reason = F.when(F.col("found").isNull(), "resource_file_not_found").when(F.col("value").isNull(), "resource_key_not_found").otherwise("")
    return joined.select("field", F.col("value").alias("text"), reason.alias("reason"))
